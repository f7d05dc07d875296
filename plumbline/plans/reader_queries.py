"""Each reader over result rows made from the parts table, with holes and values at the bars."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.operators import readers as R
from plumbline.plans.inputs import read
from plumbline.plans.registry import query

#: Fields that are not numbers on a ladder: expressions of the key k that both engines read alike.
TEXTS = {"g1_verdict": "PASS", "g4_verdict": "PASS", "recommendation": "SELECT", "withholding_mode": "physics", "market_event": "x", "market_event_url": "x", "licence_url": "x", "mechanism": "x", "buyer_type": "x"}
WHOLE = {"n_rungs": 4, "n_test_epochs": 20000, "n_satellites": 20, "n_train": 100, "matched_rung": 100, "post_event_efforts": 1, "units": 1000000, "n_queries": 3, "n_queries_ok": 3, "laws_survived": 4, "laws_with_reason": 4, "families_clearing": 5, "families_needed": 5, "n": 1000}
REAL = {"decades_spanned": 2.0, "months_ago": 24.0, "bytes_per_unit": 20000.0, "chance": 0.04, "correct": 89.0, "other_correct": 39.0, "slope": 0.12, "slope_bar": 0.12, "entropy_bits": 2.0, "margin_over_baseline": 0.06, "null_train": 0.4}
LOW = ("shuffled", "null", "frozen", "expanded", "trivial", "feature", "pooled", "baseline", "floored", "best")


def field(name: str, i: int) -> str:
    """The i-th field: right for most rows, off the bar or missing for some that differ by field."""
    p, q = (7, 11, 13, 17, 19, 23, 29, 31, 37, 41)[i % 10], (43, 47, 53, 59, 61, 67)[i % 6]
    if name.endswith("_ok") and name != "n_queries_ok":
        return f"CASE WHEN k % {p} = {i % p} THEN false WHEN k % {q} > 0 THEN true END"
    if name in TEXTS:
        return f"CASE WHEN k % {p} = {i % p} THEN '' WHEN k % {q} > 0 THEN '{TEXTS[name]}' END"
    if name in WHOLE:
        return f"CASE WHEN k % {p} = {i % p} THEN {WHOLE[name] - 1} WHEN k % {q} > 0 THEN {WHOLE[name]} END"
    if name in REAL:
        return f"CASE WHEN k % {p} = {i % p} THEN {REAL[name]}e0 - 0.5e0 WHEN k % {q} > 0 THEN {REAL[name]}e0 END"
    if name.startswith(LOW) or name.endswith("_top5") and name != "top5":
        return f"CASE WHEN k % {p} = {i % p} THEN 0.7e0 WHEN k % {q} > 0 THEN 0.05e0 END"
    if re.search("top1|top5|auc|selective|low|accuracy", name):
        return f"CASE WHEN k % {p} = {i % p} THEN -0.1e0 WHEN k % {q} > 0 THEN 0.6e0 END"
    negative = name in ("open_dataset_at_1e6", "corpora_share_source_chunks", "after_the_fact_loss")
    return f"CASE WHEN k % {p} = {i % p} THEN {str(negative).lower()} WHEN k % {q} > 0 THEN {str(not negative).lower()} END"


WORDS = {"and", "not", "in", "ceil", "trim"}


def fields(reader: R.Reader) -> list[str]:
    text = " ".join(re.sub(r"'[^']*'", "", c) for t in reader.tiers for c in t.conditions.values())
    names = dict.fromkeys(w for w in re.findall(r"(?<![\d.])\b[a-z]\w*", text) if w not in WORDS)
    return list(names)


def rows(spark, d, reader):
    own = [F.expr(field(n, i)).alias(n) for i, n in enumerate(fields(reader))]
    return read(spark, d, "part").select(F.col("p_partkey").alias("k")).select("k", *own)


def rows_sql(reader: R.Reader) -> str:
    own = ", ".join(f"{field(n, i)} AS {n}" for i, n in enumerate(fields(reader)))
    return f"r AS (SELECT k, {own} FROM (SELECT p_partkey AS k FROM part))"


def verdict_sql(reader: R.Reader) -> str:
    """The tiers as one CASE, and the failed conditions of the deciding tier."""
    case, why = [], []
    for t in reader.tiers:
        holds = " AND ".join(f"coalesce({c}, false)" for c in t.conditions.values())
        case.append(f"WHEN NOT ({holds}) THEN '{t.verdict}'")
        listed = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, c in t.conditions.items())
        why.append(f"WHEN NOT ({holds}) THEN concat_ws('; ', {listed})")
    return f"CASE {' '.join(why)} ELSE '' END AS failed, CASE {' '.join(case)} ELSE '{reader.passed}' END AS verdict"


def register(name: str, reader: R.Reader) -> None:
    @query(f"reader_{name}", f"WITH {rows_sql(reader)} SELECT k, {verdict_sql(reader)} FROM r")
    def run(spark, d):
        return R.read_verdict(rows(spark, d, reader), name).select("k", F.array_join("failed", "; ").alias("failed"), "verdict")


for _name, _reader in R.READERS.items():
    register(_name, _reader)

VOID = R.Reader([R.Tier("VOID", {v: f"{v}_ok" for v in R.VALIDITY})], "", ())
GAIN = "CASE WHEN k % 5 = 0 THEN 'GAIN_NOT_RESOLVED' ELSE 'RISES' END"
LEAD = "CASE WHEN k % 3 = 0 THEN 'NO_SEPARATION' ELSE 'MODEL_LEADS' END"


for _name in ("realcurve2_4096", "realcurve3_4096"):

    @query(f"reader_{_name}", f"WITH {rows_sql(VOID)}, v AS (SELECT k, {verdict_sql(VOID)} FROM r) SELECT k, failed, CASE WHEN verdict = 'VOID' THEN 'VOID' ELSE {GAIN} || '_' || {LEAD} END AS verdict FROM v")
    def composite(spark, d):
        out = R.composite_verdict(rows(spark, d, VOID), F.expr(GAIN), F.expr(LEAD))
        return out.select("k", F.array_join("failed", "; ").alias("failed"), "verdict")


C1 = R.READERS["c1_falsifier"]


@query("reader_c1_overall", f"WITH {rows_sql(C1)}, v AS (SELECT *, {verdict_sql(C1)} FROM r) SELECT count(*) FILTER (verdict = 'SELECTS') AS n_selected, CASE WHEN count(*) < 12 OR count(DISTINCT withholding_mode) FILTER (withholding_mode <> '') < 4 THEN 'VOID_SEARCH_TOO_NARROW' WHEN count(*) FILTER (verdict = 'SELECTS') > 0 THEN 'C1_FALSIFIED' ELSE 'NO_FALSIFIER_FOUND' END AS verdict FROM v")
def c1(spark, d):
    wide = (F.count("*") >= 12) & (F.count_distinct(F.when(F.col("withholding_mode") != "", F.col("withholding_mode"))) >= 4)
    return R.overall(R.read_verdict(rows(spark, d, C1), "c1_falsifier"), "SELECTS", wide, "C1_FALSIFIED", "NO_FALSIFIER_FOUND")
