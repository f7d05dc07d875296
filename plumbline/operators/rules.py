"""Fail-closed rule evaluation: every clause a row fails is listed; null or ill-typed fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clause = tuple[str, Column]
TOLERANCE = 1e-9


def failed(clauses: list[Clause]) -> Column:
    """Names of the clauses that do not hold, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in clauses]))


def number(c: Column) -> Column:
    """A double that is finite, else null (so clauses over it fail)."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def verdict(df: DataFrame, clauses: list[Clause], passed: str, fell: str, scope: list[Clause] | None = None, void: str = "VOID") -> DataFrame:
    """df with `void_clauses`, `failed` and `verdict`: void before failed before passed."""
    out = df.withColumn("void_clauses", failed(scope) if scope else F.array().cast("array<string>")).withColumn("failed", failed(clauses))
    return out.withColumn("verdict", F.when(F.size("void_clauses") > 0, void).when(F.size("failed") > 0, fell).otherwise(passed))


def screen(df: DataFrame, clauses: list[Clause], measured: Column) -> DataFrame:
    """Candidates with their failures; one that passes but was not measured first hand stays out."""
    out = df.withColumn("failed", F.concat(failed(clauses), failed([("not measured", measured)])))
    return out.withColumn("selected", F.size("failed") == 0)


def override(recommendation: Column, gates: list[Clause], select: str = "SELECT", reject: str = "REJECT") -> Column:
    """A reviewer's choice, unless its own gates fail."""
    return F.when((recommendation == select) & (F.size(failed(gates)) > 0), reject).otherwise(F.coalesce(recommendation, F.lit(reject)))


def recompute(banked: DataFrame, ours: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys where a banked number is not exactly what the vectors give, or one side has no row."""
    a = banked.select(*keys, *[F.col(v).alias(f"banked_{v}") for v in values], F.lit(True).alias("_a"))
    b = ours.select(*keys, *[F.col(v).alias(f"own_{v}") for v in values], F.lit(True).alias("_b"))
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"banked_{v}").eqNullSafe(F.col(f"own_{v}"))
    return a.join(b, keys, "full_outer").where(differs | F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b")


def interval_reading(low: Column, high: Column, bar: float) -> Column:
    """falls / rises_below / rises / not_resolved, in that order."""
    return F.when(high < 0, "falls").when((low > 0) & (high < bar), "below_rate").when(low > 0, "rises").otherwise("not_resolved")


def composite(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def count_bar(n: Column, share: float) -> Column:
    """The least whole count that reaches a share of n."""
    return F.ceil(n * share - TOLERANCE)


def reproduces(x: Column, reference: Column, tolerance: float) -> Column:
    return F.abs(x - reference) <= tolerance


def null_control(score: Column, chance: float, tolerance: float, train: Column, least: float) -> Column:
    """The control reads chance, and could have failed: its train score shows that it learned."""
    return (score <= chance + tolerance) & (train >= least)


def literals(df: DataFrame, expected: dict[str, object]) -> list[Clause]:
    """Scope clauses: null-safe equality with sealed values."""
    return [(f"{k} is not as sealed", F.col(k).eqNullSafe(F.lit(v)) if k in df.columns else F.lit(False)) for k, v in expected.items()]


def coverage_problems(entries: DataFrame, artifacts: DataFrame, key: str, artifact: str, value: str, classes: list[str]) -> DataFrame:
    """Problem rows: the artifact is missing, its value differs, the class is unknown, or a claim
    that cannot be verified gives no reason."""
    have = artifacts.select(F.col(artifact), F.col(value).alias("_value"), F.lit(True).alias("_there"))
    j = entries.join(have, artifact, "left")
    clauses = [
        ("no artifact", F.col("_there")), ("value differs", F.col(value).eqNullSafe(F.col("_value")) | F.col("_there").isNull()),
        ("unknown class", F.col("class").isin(classes)), ("no reason", (F.col("class") != "unverifiable") | (F.length(F.trim("why")) > 0)),
    ]
    return j.select(key, F.explode(failed(clauses)).alias("problem"))


#: Named rule sets, each from a DataFrame to one with its verdict. Callers may add their own.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rule(name: str):
    def put(f):
        RULES[name] = f
        return f

    return put


@rule("scaling_curve")
def scaling_curve(df: DataFrame) -> DataFrame:
    """A curve is established if scope, slope, margin, null control and grouping all hold."""
    n = lambda c: number(F.col(c))
    return verdict(df, [
        ("fewer than 4 rungs", F.col("n_rungs") >= 4), ("under 2 decades", n("decades_spanned") >= 2.0 - TOLERANCE), ("slope interval reaches 0", n("slope_ci95_low") > 0),
        ("margin under the bar", n("top_rung_accuracy") - n("best_trivial_baseline") >= 0.05 - TOLERANCE), ("null control above chance", n("shuffled_label_accuracy") <= n("chance_accuracy") + 0.02),
        ("split is not grouped", F.col("split_is_grouped_by_source")),
    ], "CURVE_ESTABLISHED", "CURVE_NOT_ESTABLISHED")
