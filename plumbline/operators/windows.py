"""Ordered operators: ordinals, run lengths, first appearance, chains, ledgers, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a running total over a whole table is cut into.
RANGES = 256


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with `out`: the sum of value over all rows of lesser or equal (numeric) order.

    One global window would bring all rows to one task. Rows of equal order are summed first, so a
    frequent value is one row; the distinct values fall into ranges cut at their quantiles, range
    totals (RANGES rows) are run up in one small window, and each range runs up its own values."""
    x = F.col(order).cast("double")
    per = df.groupBy(order).agg(F.sum(value).alias("_v"))
    cuts = per.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))  # one row
    place = F.size(F.filter("_cuts", lambda c: c < x))
    cut = per.crossJoin(F.broadcast(cuts)).withColumn("_range", place).drop("_cuts")  # one row
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_range").agg(F.sum("_v").alias("_t")).select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = cut.join(F.broadcast(totals), "_range").select(order, (F.col("_before") + own).alias(out))  # RANGES rows
    return df.join(upto, order)


def ordinal(df: DataFrame, by: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: by, run (from 1), value, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "run", value).agg(F.count("*").alias("length"))


def expand_runs(runs: DataFrame, by: list[str], run: str, length: str, value: str) -> DataFrame:
    """The sequence that run lengths stand for: by, pos (from 0), value."""
    before = F.sum(length).over(Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(length)
    return runs.withColumn("_b", before).select(*by, value, "_b", F.posexplode(F.sequence(F.lit(1), F.col(length).cast("int"))).alias("_i", "_x")).select(*by, (F.col("_b") + F.col("_i")).cast("long").alias("pos"), value)


def first_appearance(df: DataFrame, by: list[str], key: str, position: str) -> DataFrame:
    """Keys in the order of their first position: by, key, first, place (from 1)."""
    first = df.groupBy(*by, key).agg(F.min(position).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first", key)))


def differences(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "gain") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def stalled(df: DataFrame, by: list[str], order: list[str], value: str, last: int = 4) -> DataFrame:
    """df with `stalled`: the value of this and the `last` - 1 rows before it is one and the same."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(last - 1), 0)
    return df.withColumn("stalled", (F.count(value).over(w) == last) & (F.min(value).over(w) == F.max(value).over(w)))


GENESIS = "0" * 64


def link_hash(prev: Column, seq: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, seq.cast("string"), body), 256)


def verify_chain(df: DataFrame, seq: str, body: str, prev: str, own: str, chain: list[str]) -> DataFrame:
    """Per entry: whether the sequence has no gap, prev is the last entry's hash, and the hash is
    what its fields give. Chains are checked side by side; one chain is one ordered pass."""
    w = Window.partitionBy(*chain).orderBy(seq)
    return df.select(
        *chain, seq,
        (F.col(seq) == F.row_number().over(w) - 1).alias("seq_ok"),
        F.col(prev).eqNullSafe(F.lag(own, 1, GENESIS).over(w)).alias("prev_ok"),
        F.col(own).eqNullSafe(link_hash(F.col(prev), F.col(seq), F.col(body))).alias("hash_ok"),
    )


def nested_check(members: DataFrame, step: str, group: str) -> DataFrame:
    """Per step: groups, those of the step before that are missing, and whether the count grew."""
    nxt = members.select((F.col(step) + 1).alias(step), group)
    gone = nxt.join(members.select(step, group), [step, group], "left_anti").groupBy(step).agg(F.count("*").alias("_gone"))
    n = members.groupBy(step).agg(F.count("*").alias("n_groups"))
    before = F.lag("n_groups").over(Window.orderBy(step))
    return n.join(gone, step, "left").select(step, "n_groups", F.coalesce("_gone", F.lit(0)).alias("n_missing"), F.coalesce(F.col("n_groups") > before, F.lit(True)).alias("grew"))


def attempts(ledger: DataFrame, by: list[str], event: str) -> DataFrame:
    """Per task: starts, completions, whether one is open, and whether it completed exactly once."""
    per = ledger.groupBy(*by).agg(F.count_if(F.col(event) == "started").alias("n_started"), F.count_if(F.col(event) == "completed").alias("n_completed"))
    return per.withColumn("open", F.col("n_started") > F.col("n_completed")).withColumn("completed_once", F.col("n_completed") == 1)


def starts_since_terminal(ledger: DataFrame, by: list[str], order: list[str], event: str, terminal: list[str]) -> DataFrame:
    """Per task: starts after its last terminal event."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = ledger.withColumn("_ended", F.max(F.col(event).isin(terminal).cast("int")).over(w))
    return after.groupBy(*by).agg(F.count_if((F.col("_ended") == 0) & (F.col(event) == "started")).alias("n_open_starts"))


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """A column ac_<lag> each: the correlation of the series with itself moved; 0 where constant."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = df.select(*by, F.col(value).cast("double").alias("_x"), *[F.lag(F.col(value).cast("double"), k).over(w).alias(f"_x{k}") for k in lags])
    def one(k: int) -> Column:
        x, y = F.when(F.col(f"_x{k}").isNotNull(), F.col("_x")), F.col(f"_x{k}")
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.coalesce(F.covar_pop(x, y) / F.when(spread > 0, spread), F.lit(0.0)).alias(f"ac_{k}")

    return moved.groupBy(*by).agg(*[one(k) for k in lags])


def batch_order(df: DataFrame, batch: str, position: str, tie: str) -> DataFrame:
    """Canonical order: batches by first appearance, rows by position inside; place (from 0) in the
    whole, out of batch totals run up over one row a batch."""
    first = df.groupBy(batch).agg(F.min(F.struct(position, tie)).alias("first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = first.select(batch, before.alias("_before"))
    return df.join(base, batch).withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy(batch).orderBy(position, tie)) - 1).drop("_before")


def top_share(df: DataFrame, by: list[str], score: str, key: str, percent: int, highest: bool = True) -> DataFrame:
    """The top (or bottom) percent of each group by score, at least one row; ties by key."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.desc(score) if highest else F.asc(score), F.col(key)))
    return df.withColumn("_r", place).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_r", "_n")


def staged_selection(df: DataFrame, by: list[str], stages: list[tuple[str, int]], key: str) -> DataFrame:
    """Successive selection: at each stage rank those left by its score, and keep so many."""
    out = df
    for score, keep in stages:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(key)))).where(F.col("_r") <= keep).drop("_r")
    return out


def worst_reading(df: DataFrame, by: list[str], reading: str, order: list[str]) -> DataFrame:
    """The least flattering reading of each group, by a fixed order of readings."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(reading))
    return df.groupBy(*by).agg(F.min_by(reading, place).alias("worst"))
