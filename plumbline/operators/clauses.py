"""Validity clauses of a sealed run: each is a table of problems, or a row with its facts and `ok`.

A clause is fail-closed like every rule here: what is missing, null or not comparable is not ok.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.portable import key_hash
from plumbline.operators.joins import compare_keys
from plumbline.operators.rules import TOLERANCE, count_bar, failed


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def protocol_problems(sealed: DataFrame, run: DataFrame, key: str, value: str) -> DataFrame:
    """Entries of the union of both protocols that are missing in the run, extra, or differ."""
    both = compare_keys(sealed, run, key, value)
    return both.select(key, F.when(~F.col("in_right"), "missing").when(~F.col("in_left"), "extra").otherwise("differs").alias("problem"))


def index_digest(rows: DataFrame, part: str, index: str) -> DataFrame:
    """Rows and an order-free digest of the row ids, by part."""
    return rows.groupBy(part).agg(F.count("*").alias("n"), F.sum(key_hash(index).cast("decimal(38,0)")).cast("string").alias("digest"))


def sealed_parts(sealed: DataFrame, rows: DataFrame, part: str, index: str) -> DataFrame:
    """Per part of the seal or the rows: whether the count and the ids are as sealed."""
    own = index_digest(rows, part, index).select(part, F.col("n").alias("own_n"), F.col("digest").alias("own_digest"))
    both = sealed.select(part, "n", "digest").join(own, part, "full_outer")
    return both.select(part, holds(F.col("n") == F.col("own_n")).alias("n_ok"), holds(F.col("digest") == F.col("own_digest")).alias("ids_ok"))


def leakage(train: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row: per key how many distinct values are on both sides, and ok if none is."""
    out = None
    for k in keys:
        shared = train.select(k).distinct().join(scored.select(k).distinct(), k).agg(F.count("*").alias(f"shared_{k}"))
        out = shared if out is None else out.crossJoin(shared)  # one row each
    total = sum((F.col(f"shared_{k}") for k in keys[1:]), F.col(f"shared_{keys[0]}"))
    return out.withColumn("ok", total == 0)


def environment(fits: DataFrame, launch: DataFrame, by: list[str], env: str) -> DataFrame:
    """Per run: fits, how many were made in another environment than the launch's, and ok."""
    held = fits.select(*by, F.col(env).alias("_fit")).join(launch.select(*by, F.col(env).alias("_launch")), by, "left")
    out = held.groupBy(*by).agg(F.count("*").alias("n_fits"), F.count_if(~F.col("_fit").eqNullSafe(F.col("_launch")) | F.col("_launch").isNull()).alias("n_other"))
    return out.withColumn("ok", F.col("n_other") == 0)


def vector_binding(rows: DataFrame, by: list[str], order: list[str], index: str, value: Column, low: int, high: int, chunk: str, expected: Column) -> DataFrame:
    """Per vector: length as expected, values 0 or 1 only, ids within a range and in build order,
    and its number of chunks."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = rows.withColumn("_before", F.lag(index).over(w)).withColumn("_value", value).withColumn("_expected", expected)
    out = steps.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") == F.max("_expected")).alias("length_ok"), F.min(holds(F.col("_value").isin(0, 1))).alias("domain_ok"),
        F.min(holds(F.col(index).between(low, high))).alias("range_ok"), F.min(F.col("_before").isNull() | (F.col("_before") <= F.col(index))).alias("order_ok"), F.count_distinct(chunk).alias("n_chunks"),
    )
    return out.withColumn("length_ok", holds(F.col("length_ok")))


def fit_problems(df: DataFrame, sealed: dict[str, object], stored: str, recomputed: Column) -> Column:
    """What of a fit record is not as sealed: fields, or a fingerprint that is not its own."""
    fields = [(f"{k} is not as sealed", F.col(k).eqNullSafe(F.lit(v))) for k, v in sealed.items()]
    return failed([*fields, ("fingerprint is not the record's", F.col(stored) == recomputed)])


def ledger_order(ledger: DataFrame, stage: str, fit: str, time: list[str], event: str) -> DataFrame:
    """Per fit: exactly one completion, a start before it, and a completion after those of all fits
    that come before it in its stage's sealed order."""
    at = F.struct(*time)
    per = ledger.groupBy(stage, fit).agg(
        F.count_if(F.col(event) == "completed").alias("n_completed"), F.min(F.when(F.col(event) == "started", at)).alias("_started"), F.min(F.when(F.col(event) == "completed", at)).alias("_completed"),
    )
    before = F.max("_completed").over(Window.partitionBy(stage).orderBy(fit).rowsBetween(Window.unboundedPreceding, -1))  # a row a fit
    return per.withColumn("_last", before).select(
        stage, fit, (F.col("n_completed") == 1).alias("once"), holds(F.col("_started") < F.col("_completed")).alias("started_before"),
        holds(F.col("_last").isNull() | (F.col("_last") < F.col("_completed"))).alias("in_order"),
    )


def record_against_vector(record: DataFrame, vector: DataFrame, family: str, index: str, correct: str, places: int = 4) -> DataFrame:
    """Per family: whether stored mean, count and vector digest are what the vector gives."""
    bit = key_hash(index, correct).cast("decimal(38,0)")
    own = vector.groupBy(family).agg(F.round(F.avg(F.col(correct).cast("double")), places).alias("own_mean"), F.count("*").alias("own_n"), F.sum(bit).cast("string").alias("own_digest"))
    both = record.join(own, family, "full_outer")
    return both.select(family, *[holds(F.col(c) == F.col(f"own_{c}")).alias(f"{c}_ok") for c in ("mean", "n", "digest")])


def readings_rederived(stored: DataFrame, means: DataFrame, key: str, mean: str, bar: float) -> DataFrame:
    """Per family or subset its reading from the mean, and whether the stored one is the same."""
    reading = F.when(F.col(mean) >= bar - TOLERANCE, "clears").when(F.col(mean).isNotNull(), "fails")
    both = stored.select(key, F.col("reading").alias("_stored")).join(means.select(key, reading.alias("reading")), key, "full_outer")
    return both.select(key, "reading", holds(F.col("reading") == F.col("_stored")).alias("ok"))


def lead_reading(linear_low: Column, linear_high: Column, tree_low: Column, tree_high: Column) -> Column:
    """Who leads, by the signs of the intervals of model minus linear and model minus tree."""
    model = (linear_low > 0) & (tree_low > 0)
    return F.when(model, "MODEL_LEADS").when(linear_high < 0, "LINEAR_LEADS").when(tree_high < 0, "TREE_LEADS").otherwise("NO_SEPARATION")


def isolation_problems(stored_hash: Column, disk_hash: Column, gathered: Column, finished: Column, confirmed: Column) -> Column:
    """Why a selection was not isolated from what was scored after it (times are ISO strings)."""
    return failed([("selection file differs", stored_hash == disk_hash), ("scored rows were gathered", gathered == 0), ("confirmed before selection ended", finished <= confirmed)])


def symmetric_search(roster: DataFrame, by: list[str], present: str, baseline: str, evidence: str, most_missing: int) -> DataFrame:
    """Per search: a missing baseline voids it, a missing model arm needs evidence, and only so many
    may be missing."""
    gone = ~holds(F.col(present))
    out = roster.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(gone & F.col(baseline)).alias("n_baselines"), F.count_if(gone & ~F.col(baseline)).alias("n_arms"), F.count_if(gone & ~F.col(baseline) & ~holds(F.col(evidence))).alias("n_unexplained"),
    )
    return out.withColumn("verdict", F.when((F.col("n_baselines") > 0) | (F.col("n_unexplained") > 0) | (F.col("n_arms") > most_missing), "VOID").otherwise("VALID"))


def same_rows(stored: DataFrame, rule: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stored choice that the rule does not give, and the reverse."""
    a, b = stored.select(*keys).distinct().withColumn("_a", F.lit(True)), rule.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "not chosen").otherwise("not the rule's").alias("problem"))


def family_floors(rows: DataFrame, family: str, correct: str, floor: str, margin: float = 0.05) -> DataFrame:
    """Per family: rows, the count it needs to clear its own floor by a margin, and whether it does."""
    per = rows.groupBy(family).agg(F.count("*").alias("n"), F.sum(correct).alias("correct"), F.max(floor).alias("_floor"))
    need = F.ceil(F.col("n") * (F.col("_floor") + margin) - TOLERANCE)
    return per.select(family, "n", "correct", need.alias("need"), holds(F.col("correct") >= need).alias("clears"))


def count_lead(rows: DataFrame, by: list[str], role: str, a: str, b: str, correct: str, share: float) -> DataFrame:
    """Per group: how many rows more one role has right, and whether that is a share of the rows."""
    right = lambda r: F.sum(F.when(F.col(role) == r, F.col(correct)))
    per = rows.groupBy(*by).agg(F.count_if(F.col(role) == a).alias("n"), (right(a) - right(b)).alias("difference"))
    return per.withColumn("leads", holds(F.col("difference") >= count_bar(F.col("n"), share)))


def two_clause_curve(slope: Column, low: Column, bar: float) -> Column:
    """A curve rises if its slope reaches the bar and its interval lies above zero."""
    return F.when(holds((slope >= bar - TOLERANCE) & (low > 0)), "RISES").otherwise("FLAT")
