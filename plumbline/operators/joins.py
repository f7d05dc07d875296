"""Joins: lookups with fallback, as-of, key-set checks, digest matches, rounded-band matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, own: str, other: str, out: str) -> DataFrame:
    """left with `out`: its own value, or the other table's where its own is null."""
    side = right.select(F.col(key), F.col(other).alias("_other"))
    return left.join(side, key, "left").withColumn(out, F.coalesce(own, "_other")).drop("_other")


def asof(points: DataFrame, records: DataFrame, key: str, point_time: str, record_time: str, tolerance: float, tie: str, healthy: Column | None = None) -> DataFrame:
    """Each point with the key's latest record at or before it, within the tolerance (inclusive).

    Health is judged after selection: an unhealthy newest record drops the point, without a
    fallback. Ties in time go to the larger `tie`. One union and one window a key: no theta join."""
    rec_cols = [c for c in records.columns if c != key]
    packed = records.select(key, F.col(record_time).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*rec_cols).alias("_rec"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_pt"))
    asked = points.select(key, F.col(point_time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(records.schema[tie].dataType).alias("_tie"), F.lit(None).cast(packed.schema["_rec"].dataType).alias("_rec"), F.struct(*points.columns).alias("_pt"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = packed.unionAll(asked).withColumn("_rec", F.last("_rec", ignorenulls=True).over(w)).where("_side = 1 and _rec is not null")
    near = last.where(F.col("_pt")[point_time].cast("double") - F.col("_rec")[record_time].cast("double") <= tolerance)
    out = near.select(*[F.col("_pt")[c].alias(c) for c in points.columns], *[F.col("_rec")[c].alias(c) for c in rec_cols if c not in points.columns])
    return out.where(healthy) if healthy is not None else out


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on either side, and how many both have (a leak check)."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_shared"))


def with_digest(df: DataFrame, columns: list[str], out: str = "digest") -> DataFrame:
    """A content hash over columns; a null differs from an empty text."""
    return df.withColumn(out, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256))


def content_matches(probe: DataFrame, scored: DataFrame, columns: list[str], probe_id: str, scored_id: str) -> DataFrame:
    """Probe rows that equal some scored row, with the least such row and their number."""
    have = with_digest(scored, columns).groupBy("digest").agg(F.min(scored_id).alias("matched"), F.count("*").alias("n_matches"))
    return with_digest(probe, columns).join(have, "digest").select(probe_id, "matched", "n_matches")


def equal_pairs(df: DataFrame, digest: str, key: str) -> DataFrame:
    """Rows that equal an earlier row (least key of the digest): class links, never all pairs."""
    first = df.groupBy(digest).agg(F.min(key).alias("first"), F.count("*").alias("n_class"))
    return df.join(first.where("n_class > 1"), digest).where(F.col(key) > F.col("first")).select(F.col("first"), F.col(key).alias("copy"), "n_class")


def match_first(targets: DataFrame, candidates: DataFrame, digest: str, target_id: str, candidate: str) -> DataFrame:
    """Each target's first matching candidate; more than one match is a tie; none is kept as null."""
    best = candidates.groupBy(digest).agg(F.min(candidate).alias("decoded"), F.count("*").alias("n_matches"))
    return targets.join(best, digest, "left").select(target_id, "decoded", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), (F.coalesce("n_matches", F.lit(0)) > 1).alias("tie"))


def backed(tokens: DataFrame, token: str, banked: DataFrame, value: str) -> DataFrame:
    """tokens with `backed`: whether some banked value, times 1, 100 or 1/100, rounds to the token
    at its own precision. Values are rounded once per precision that occurs, and joined as equals."""
    asked = tokens.withColumn("_places", F.length(F.regexp_extract(token, r"\.(\d+)", 1)))
    precisions = sorted(r[0] for r in asked.select("_places").distinct().collect() if r[0] is not None)  # lengths of numbers, so few
    if not precisions:
        return asked.withColumn("backed", F.lit(False)).drop("_places")
    at = lambda p, x: F.round(x, max(p, 12))
    key = F.coalesce(*[F.when(F.col("_places") == p, at(p, F.col(token).cast("double"))) for p in precisions])
    cells = F.array(*[F.struct(F.lit(p).alias("_places"), at(p, F.round(F.col(value) * m if m >= 1 else F.col(value) / 100.0, p)).alias("_key")) for p in precisions for m in (1.0, 100.0, 0.01)])
    have = banked.select(F.explode(cells).alias("c")).select("c.*").distinct().withColumn("_hit", F.lit(True))
    return asked.withColumn("_key", key).join(have, ["_places", "_key"], "left").withColumn("backed", F.coalesce("_hit", F.lit(False))).drop("_places", "_key", "_hit")


def nearest(probe: DataFrame, train: DataFrame, key: str, features: str, label: str) -> DataFrame:
    """1-nearest neighbour by squared distance, ties to the least train key.

    Distances come from one blocked matrix product a task: train rows are cut into blocks by key
    hash, every probe row meets each block once, and blocks meet in a pre-aggregated minimum."""
    import pandas as pd

    def block(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        is_train = group["side"].to_numpy() == 0
        t, p = group[is_train].sort_values("id"), group[~is_train]
        if not len(t) or not len(p):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": [], "label": []})
        a, b = np.stack(p["x"].to_list()).astype(float), np.stack(t["x"].to_list()).astype(float)
        out_n, out_d = np.empty(len(a), np.int64), np.empty(len(a))
        for lo in range(0, len(a), 256):
            d = ((a[lo : lo + 256, None, :] - b[None, :, :]) ** 2).sum(2)
            out_n[lo : lo + 256], out_d[lo : lo + 256] = d.argmin(1), d.min(1)
        return pd.DataFrame({"id": p["id"].to_numpy(), "neighbour": t["id"].to_numpy()[out_n], "distance": out_d, "label": t["y"].to_numpy()[out_n]})

    n = max(1, train.rdd.getNumPartitions())
    t = train.select(F.lit(0).alias("side"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.col(key).cast("long").alias("id"), F.col(features).alias("x"), F.col(label).cast("long").alias("y"))
    p = probe.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col(key).cast("long").alias("id"), F.col(features).alias("x"), F.lit(None).cast("long").alias("y"))
    near = t.unionAll(p).groupBy("block").applyInPandas(block, "id long, neighbour long, distance double, label long")
    best = near.groupBy("id").agg(F.min(F.struct("distance", "neighbour", "label")).alias("b"))
    return best.select(F.col("id").alias(key), "b.neighbour", "b.label", "b.distance")


def compare_keys(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks (null-safe)."""
    left, right = a.select(key, F.col(value).alias("left_value"), F.lit(True).alias("in_left")), b.select(key, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    both = left.join(right, key, "full_outer").withColumns({"in_left": F.coalesce("in_left", F.lit(False)), "in_right": F.coalesce("in_right", F.lit(False))})
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")) | ~F.col("in_left") | ~F.col("in_right"))


def zipped(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Arrays side by side: a row for each place, null where one is shorter."""
    pairs = F.arrays_zip(*arrays)
    return df.select(*keys, F.posexplode(pairs).alias("pos", "_z")).select(*keys, "pos", *[F.col("_z")[c].alias(c) for c in arrays])


def stitch(rows: DataFrame, fold_scores: DataFrame, key: str, family: str, fold: str, score: str) -> DataFrame:
    """Each row's score from the fold that held out its family."""
    return rows.join(fold_scores.select(key, F.col(fold).alias("_fold"), score), key).where(F.col("_fold") == F.col(family)).drop("_fold")


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: row counts, and how many keys one side lacks."""
    x = a.select(*keys, F.lit(1).alias("_a"))
    y = b.select(*keys, F.lit(1).alias("_b"))
    j = x.join(y, keys, "full_outer")
    return j.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"))


def union_offset(frames: list[DataFrame], row_id: str, offsets: list[int]) -> DataFrame:
    """UNION ALL of corpora whose row ids are moved apart."""
    return reduce(DataFrame.unionByName, [f.withColumn(row_id, F.col(row_id) + o) for f, o in zip(frames, offsets, strict=True)])
