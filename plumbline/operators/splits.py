"""Splits, samples and nested prefixes. Groups never straddle a split; every draw is a hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.portable import key_hash
from plumbline.operators.windows import running_total


#: Ranges of the 60-bit hash that a global order is cut into, each ordered by a task of its own.
RANGE_BITS = 12


def hash_order(df: DataFrame, seed: int, key: str, rank: str = "r") -> DataFrame:
    """df with `rank` (from 1) in the seed's order over all rows, and their number `n`.

    Hashes are even, so ranges of them hold about as many rows each; only the ranges' counts (2^12
    rows) go through a window over everything."""
    held = df.withColumn("_h", key_hash(seed, key)).withColumn("_range", F.shiftright("_h", 60 - RANGE_BITS))
    counts = held.groupBy("_range").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    return held.join(F.broadcast(starts), "_range").withColumn(rank, F.col("_before") + own).drop("_h", "_range", "_before")  # 2^12 rows


def ranked_groups(df: DataFrame, group: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """The distinct groups, each with its place `r` (from 1) in the seed's order and their number `n`.

    One row a group is ordered; rows themselves are never ranked. With strata, each is ordered alone."""
    if not within:
        return hash_order(df.select(group).distinct(), seed, group)
    ordered = df.select(*within, group).distinct().withColumn("_h", key_hash(seed, group))
    w = Window.partitionBy(*within).orderBy("_h", group)
    return ordered.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*within))).drop("_h")


def grouped_split(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """df with `part`: eval for the first max(1, int(n * fraction)) groups of the order, else train."""
    groups = ranked_groups(df, group, seed)
    size = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    return df.join(groups.select(group, F.when(F.col("r") <= size, "eval").otherwise("train").alias("part")), group)


def random_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """df with `part`: as grouped_split, each row its own group."""
    return grouped_split(df, key, fraction, seed)


def temporal_split(df: DataFrame, order: list[str], percent: int) -> DataFrame:
    """df with `part`: the first percent of rows in the given total order train, later ones eval.

    Ranks come from counts per leading value (a timestamp or a number), run up in parallel ranges;
    only rows of one leading value are ordered together."""
    lead = order[0]
    seconds = F.unix_micros(F.col(lead).cast("timestamp")) if "timestamp" in dict(df.dtypes)[lead] else F.col(lead)
    counts = df.groupBy(lead).agg(F.count("*").alias("_c")).withColumn("_x", seconds)
    before = running_total(counts, "_x", "_c", "_upto").select(lead, (F.col("_upto") - F.col("_c")).alias("_b"))
    total = counts.agg(F.sum("_c").alias("_n"))
    place = F.col("_b") + F.row_number().over(Window.partitionBy(lead).orderBy(*order[1:], lead))
    ranked = df.join(before, lead).crossJoin(F.broadcast(total))  # one row
    return ranked.withColumn("part", F.when(place * 100 <= F.col("_n") * percent, "train").otherwise("eval")).drop("_b", "_n")


def rung_members(df: DataFrame, position: str, rungs: list[int], validation: float = 0.1) -> DataFrame:
    """rung, part and the row: the first r rows in pool order, the last tenth of them validation."""
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("rung"), F.lit(int(r * (1 - validation))).cast("long").alias("cut")) for r in rungs])
    out = df.select("*", F.explode(cells).alias("_r")).where(F.col(position) < F.col("_r.rung"))
    return out.withColumn("rung", F.col("_r.rung")).withColumn("rung_part", F.when(F.col(position) >= F.col("_r.cut"), "validation").otherwise("fit")).drop("_r")


def leave_one_out(df: DataFrame, family: str, families: list[str]) -> DataFrame:
    """A row for each fold and part: the fold's family is held out, all others train."""
    folds = F.array(*map(F.lit, families))
    return df.select("*", F.explode(folds).alias("fold")).withColumn("part", F.when(F.col(family) == F.col("fold"), "held").otherwise("train"))


def family_blocks(df: DataFrame, family: str, group: str, position: str, families: list[str], k: int, budget: int) -> DataFrame:
    """Fixed-budget blocks: block i takes budget / k groups, by first appearance, of each of the k
    families that follow family i in the cycle."""
    n = len(families)
    first = df.groupBy(family, group).agg(F.min(position).alias("first"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(family).orderBy("first", group))).where(F.col("r") <= budget // k)
    blocks = F.array(*[F.struct(F.lit(families[i]).alias("block"), F.lit(families[(i + j) % n]).alias("_f")) for i in range(n) for j in range(k)])
    return ranked.select("*", F.explode(blocks).alias("_b")).where(F.col("_b._f") == F.col(family)).select(F.col("_b.block").alias("block"), family, group, "first", "r")


def stratified_rungs(df: DataFrame, family: str, group: str, divisors: list[int], seed: int) -> DataFrame:
    """divisor, family, group: per family the first ceil(n / d) groups of one order, so rungs nest."""
    ranked = ranked_groups(df, group, seed, [family])
    cells = F.array(*map(F.lit, divisors))
    return ranked.select("*", F.explode(cells).alias("divisor")).where(F.col("r") <= F.ceil(F.col("n") / F.col("divisor"))).select("divisor", family, group, "r")


def doublings(df: DataFrame, family: str, group: str, seed: int, base: int, steps: int) -> DataFrame:
    """step, family, group: step d holds the first base * 2^d groups of each family's order."""
    ranked = ranked_groups(df, group, seed, [family])
    cells = F.array(*map(F.lit, range(steps)))
    return ranked.select("*", F.explode(cells).alias("step")).where(F.col("r") <= base * F.pow(F.lit(2), F.col("step"))).select("step", family, group, "r", "n")


def composition(members: DataFrame, step: str, family: str) -> DataFrame:
    """Groups by step and family, with each step's total."""
    per = members.groupBy(step, family).agg(F.count("*").alias("n_groups"))
    return per.withColumn("n_step", F.sum("n_groups").over(Window.partitionBy(step)))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first of the seed's order (a distributed top-k)."""
    return df.withColumn("_h", key_hash(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """df with `shuffled`: the same labels, permuted over all rows: the row at a place of one hash
    order gets the label at that place of another."""
    a = hash_order(df, seed, key, "_r").drop("n")
    b = hash_order(df.select(key, F.col(label).alias("shuffled")), seed + 1, key, "_r").select("shuffled", "_r")
    return a.join(b, "_r").drop("_r")


def coverage(df: DataFrame, part: str, label: str, n_classes: int) -> DataFrame:
    """Per part: distinct classes, and whether all are there."""
    return df.groupBy(part).agg(F.count_distinct(label).alias("n_classes")).withColumn("covered", F.col("n_classes") == n_classes)


def shortage(df: DataFrame, family: str, needed: int) -> DataFrame:
    """Per family: rows, and how many are missing to the need."""
    per = df.groupBy(family).agg(F.count("*").alias("n"))
    return per.withColumn("missing", F.greatest(F.lit(0), F.lit(needed) - F.col("n"))).withColumn("enough", F.col("n") >= needed)
