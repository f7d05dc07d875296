"""Readers: named rule sets that turn one row of results into a verdict, fail-closed.

A reader is a list of tiers. Each tier has the verdict that it gives and the conditions that keep a
row from it, as SQL expressions over the row; the first tier with a condition that does not hold (or
is null: missing, or not a finite number) decides, and a row that passes all tiers gets the last
verdict. Validity comes first, so a void run is never a negative result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rules import RULES, failed


class Tier(NamedTuple):
    verdict: str
    conditions: dict[str, str]


class Reader(NamedTuple):
    tiers: list[Tier]
    passed: str
    numbers: tuple[str, ...]  # fields that have to be finite numbers


#: Bars of the readers.
MARGIN, NULL_TOLERANCE, EPS = 0.05, 0.02, 1e-9
SCOPE = {"rungs": "n_rungs >= 4", "decades": "decades_spanned >= 2.0"}
VALIDITY = ("scope", "protocol", "sealed_set", "leakage", "environment", "vector", "fit_record", "ledger", "record", "readings", "drift", "null_control")


def margin(high: str, low: str) -> str:
    return f"{high} - {low} >= {MARGIN}e0"


def within(value: str, chance: str) -> str:
    return f"{value} <= {chance} + {NULL_TOLERANCE}e0"


def reader(passed: str, numbers: str, **tiers: dict[str, str]) -> Reader:
    return Reader([Tier(k, v) for k, v in tiers.items()], passed, tuple(numbers.split()))


def sealed(passed: str, fails: str, conditions: dict[str, str], numbers: str = "") -> Reader:
    """A reader of a sealed run: void unless every validity clause holds."""
    return reader(passed, numbers, VOID={v: f"{v}_ok" for v in VALIDITY}, **{fails: conditions})


COUNT_BAR = {"count": f"correct >= ceil(n * (1 / 26e0 + {MARGIN}e0) - {EPS})"}
FLOORS = {"floors": "families_clearing >= families_needed"}
FLOORED_MARGIN = {"margin": f"accuracy - floored_bar >= {MARGIN}e0 - {EPS}"}
CURVE = {"slope": f"slope >= slope_bar - {EPS}", "interval": "slope_ci95_low > 0"}

#: Fields, bars and verdicts by reader.
READERS: dict[str, Reader] = {
    "ephemerr_a2": reader("A2_PASSED", "learned_auc best_baseline_auc shuffled_label_auc", A2_FAILED={
        "margin": margin("learned_auc", "best_baseline_auc"), "temporal": "split_is_temporal", "null": "shuffled_label_auc <= 0.55e0", "epochs": "n_test_epochs >= 20000", "satellites": "n_satellites >= 20"}),
    "deflate_topk": reader("OUTPUT_USABLE", "decades_spanned top5 frozen_top5 expanded_top5 selective baseline_selective top5_slope_ci95_low null_top5", OUTPUT_NOT_USABLE={
        **SCOPE, "frozen": margin("top5", "frozen_top5"), "expanded": margin("top5", "expanded_top5"), "selective": margin("selective", "baseline_selective"), "floor": "selective >= 0.5e0",
        "slope": "top5_slope_ci95_low > 0", "split": "split_is_grouped_by_source", "null": "null_top5 <= 0.2123e0"}),
    "carve_generalisation": reader("CARVE_ROBUST", "decades_spanned within_top1 frozen expanded slope_ci95_low shuffled chance transfer_top1", CARVE_FAILS={
        **SCOPE, "frozen": margin("within_top1", "frozen"), "expanded": margin("within_top1", "expanded"), "slope": "slope_ci95_low > 0", "split": "split_is_grouped_by_source", "null": within("shuffled", "chance")},
        CARVE_SIZE_SPECIFIC={"transfer": margin("transfer_top1", "frozen"), "shared": "not corpora_share_source_chunks"}),
    "byte_model": reader("BYTE_MODEL_CLEARS", "byte_top1 trivial feature_top1 shuffled chance", BYTE_MODEL_FAILS={
        "split": "split_is_grouped_by_source", "rung": "n_train = matched_rung", "margin": margin("byte_top1", "trivial"), "features": "byte_top1 > feature_top1", "null": within("shuffled", "chance")}),
    "byte_model_flat": reader("BYTE_FLAT_CLEARS", "flat_top1 trivial feature_top1 pooled_top1 null_train null_eval chance", BYTE_FLAT_FAILS={
        "split": "split_is_grouped_by_source", "same set": "eval_group_matches", "rung": "n_train = matched_rung", "margin": margin("flat_top1", "trivial"), "features": "flat_top1 > feature_top1",
        "pooled": "flat_top1 > pooled_top1", "failable": "null_train >= 0.3e0", "null": within("null_eval", "chance")}),
    "market_timing": reader("CANDIDATE", "months_ago bytes_per_unit", REJECTED={
        "event": "market_event <> '' and market_event_url <> ''", "age": "months_ago <= 24", "open data": "not open_dataset_at_1e6", "efforts": "post_event_efforts < 2", "looked": "prior_efforts_recorded",
        "manufacture": "manufacturable", "asymmetry": "asymmetry_holds", "size": "bytes_per_unit * 1e6 <= 20e9"}),
    "phase0_round4": reader("QUALIFIES", "entropy_bits margin_over_baseline slope_ci95_low bytes_per_unit", REJECTED={
        "g1": "g1_verdict = 'PASS'", "licence": "licence_url <> ''", "g4": "g4_verdict = 'PASS'", "asymmetry": "g2a_verified", "entropy": "entropy_measured and entropy_bits > 1", "margin": f"margin_measured and margin_over_baseline >= {MARGIN}e0",
        "slope": "slope_measured and slope_ci95_low > 0", "size": "bytes_per_unit * 1e6 <= 20e9", "first hand": "measured_first_hand"}),
    "phase0": reader("QUALIFIES", "", REJECTED={"recommended": "recommendation = 'SELECT'", "gates": "gates_passed", "g4": "g4_verdict = 'PASS'"}),
    "c1_falsifier": reader("SELECTS", "", REJECTED={
        "mode": "withholding_mode in ('privacy', 'regulation', 'physics', 'commercial')", "mechanism": "trim(mechanism) <> ''", "loss": "not after_the_fact_loss", "gates": "gates_true", "units": "units >= 1000000", "verified": "count_is_verified",
        "queries": "n_queries > 0 and n_queries_ok = n_queries", "laws": "laws_survived = 4 and laws_with_reason = 4", "buyer": "trim(buyer_type) <> ''"}),
    "carve2048": reader("CARVE_ROBUST", "within_top1 frozen transfer_top1", VOID={v: f"{v}_ok" for v in VALIDITY}, CARVE_FAILS={"within": margin("within_top1", "frozen")}, CARVE_SIZE_SPECIFIC={"transfer": margin("transfer_top1", "frozen")}),
    **{k: sealed("RECIPE_CLEARS", "RECIPE_FAILS", FLOORED_MARGIN, "accuracy floored_bar") for k in ("recipe2048", "recipe2048_reread", "recipe4096")},
    "lofo4096": sealed("TRANSFERS", "TRANSFER_FAILS", COUNT_BAR),
    "fdc4096": sealed("DIVERSITY_HELPS", "DIVERSITY_FLAT", {"interval": "gain_ci95_low > 0"}, "gain_ci95_low"),
    "lofol3_4096": sealed("L3_LEADS_INCUMBENT_UNDER_TRANSFER", "L3_LEAD_BELOW_BAR", {"lead": f"correct - other_correct >= ceil(n * {MARGIN}e0 - {EPS})"}),
    **{k: sealed("OOB_TRANSFERS", "OOB_TRANSFER_FAILS", COUNT_BAR) for k in ("oob4096", "oob4096_reread")},
    **{k: sealed("REAL_FIT_CLEARS", "REAL_FIT_FAILS", {**COUNT_BAR, **FLOORS}) for k in ("realfit4096", "realfit4096_rerun")},
    "realsearch4096": sealed("REAL_RECIPE_CLEARS", "REAL_RECIPE_FAILS", {"isolation": "selection_isolated", **FLOORED_MARGIN}, "accuracy floored_bar"),
    "realcurve4096": sealed("REAL_CURVE_RISES", "REAL_CURVE_FLAT", CURVE, "slope slope_bar slope_ci95_low"),
}


def condition(text: str, numbers: tuple[str, ...]) -> Column:
    """The condition, null where one of the numbers that it names is not finite."""
    ok = F.expr(text)
    for n in numbers:
        if re.search(rf"\b{n}\b", text):
            ok = F.when(~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) != float("inf")), ok)
    return ok


def read_verdict(df: DataFrame, name: str) -> DataFrame:
    """df with `failed` (the conditions of the deciding tier that do not hold) and `verdict`."""
    r = READERS[name]
    verdict, why = F.lit(r.passed), F.array().cast("array<string>")
    for tier in reversed(r.tiers):
        own = failed([(k, condition(text, r.numbers)) for k, text in tier.conditions.items()])
        verdict, why = F.when(F.size(own) > 0, tier.verdict).otherwise(verdict), F.when(F.size(own) > 0, own).otherwise(why)
    return df.withColumn("failed", why).withColumn("verdict", verdict)


def composite_verdict(df: DataFrame, curve: Column, lead: Column) -> DataFrame:
    """Void, or the readings of the gain and of the lead side by side (two-reading curve readers)."""
    void = failed([(v, F.col(f"{v}_ok")) for v in VALIDITY])
    return df.withColumn("failed", void).withColumn("verdict", F.when(F.size(void) > 0, "VOID").otherwise(F.concat_ws("_", curve, lead)))


def overall(df: DataFrame, select: str, scope: Column, found: str, none: str, void: str = "VOID_SEARCH_TOO_NARROW") -> DataFrame:
    """One row over all candidates: void where the search was too narrow, else whether any selects."""
    return df.agg(F.count_if(F.col("verdict") == select).alias("n_selected"), F.coalesce(scope, F.lit(False)).alias("_wide")).select(
        "n_selected", F.when(~F.col("_wide"), void).when(F.col("n_selected") > 0, found).otherwise(none).alias("verdict")
    )


RULES.update({name: (lambda df, name=name: read_verdict(df, name)) for name in READERS})
