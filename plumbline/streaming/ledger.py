"""Streams over append-only ledgers: tolerant reading, attempts, heartbeats, appends.

The reference's ledgers are files that grow; as streams they need event time, a watermark for late
lines, and sinks that can repeat a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ledger_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Typed JSON lines as they arrive; a line that does not parse has event `unparseable`."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    rows = raw.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r.event").isNull()
    marked = rows.select("r.*", bad.alias("_is_bad"), F.col("value").alias("raw"))
    return marked.withColumn("event", F.when(F.col("_is_bad"), "unparseable").otherwise(F.col("event"))).drop("_is_bad", "_bad")


def attempts(stream: DataFrame, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Starts and completions of each task per window of event time."""
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), "name").agg(F.count_if(F.col("event") == "started").alias("n_started"), F.count_if(F.col("event") == "completed").alias("n_completed")).select(F.col("w.start").alias("day"), "name", "n_started", "n_completed")


def heartbeats(stream: DataFrame, time: str, value: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of samples without a gap: start, end, samples, highest value."""
    timed = stream.withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("s"), "name").agg(F.count("*").alias("n"), F.max(value).alias("highest")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "name", "n", "highest")


def open_attempts(stream: DataFrame) -> DataFrame:
    """Per task the running state: open attempts, completions and the last event, by a custom
    stateful operator (state is one row a task)."""
    import pandas as pd

    def step(key, frames, state):
        open_, done, last, at = state.get if state.exists else (0, 0, "", 0.0)
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        for event, t in zip(rows["event"], rows["t"], strict=True):
            open_ = open_ + 1 if event == "started" else max(0, open_ - 1) if event == "completed" else open_
            done += event == "completed"
            last, at = (event, float(t)) if t >= at else (last, at)
        state.update((int(open_), int(done), last, at))
        yield pd.DataFrame({"name": [key[0]], "n_open": [int(open_)], "n_completed": [int(done)], "last": [last]})

    return stream.groupBy("name").applyInPandasWithState(step, "name string, n_open long, n_completed long, last string", "o long, d long, l string, t double", "update", "NoTimeout")


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is written under its own number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
