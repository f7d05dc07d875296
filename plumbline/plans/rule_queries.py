"""RD1 to RD10 and the validity clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.textnum import canonical_json, number_tokens
from plumbline.operators import joins, metrics
from plumbline.operators import rules as R
from plumbline.plans.inputs import read, scores, scores_sql
from plumbline.plans.registry import query


def curves(spark, d):
    """One result record per customer, some with holes."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        "c_custkey", (k % 3 + 3).cast("int").alias("n_rungs"), F.when(k % 11 > 0, 1.9 + (k % 4) * 0.1).alias("decades_spanned"), (F.col("c_acctbal") / 10000).alias("slope_ci95_low"),
        (0.2 + (k % 10) * 0.01).alias("top_rung_accuracy"), F.lit(0.2).alias("best_trivial_baseline"), F.when(k % 13 == 0, float("nan")).otherwise(0.04 + (k % 5) * 0.01).alias("shuffled_label_accuracy"),
        F.lit(0.04).alias("chance_accuracy"), F.when(k % 17 > 0, k % 19 > 0).alias("split_is_grouped_by_source"),
    )


CURVES = """c AS (SELECT c_custkey, c_custkey % 3 + 3 AS n_rungs, CASE WHEN c_custkey % 11 > 0 THEN 1.9::DOUBLE + (c_custkey % 4) * 0.1::DOUBLE END AS dec, c_acctbal / 10000 AS low, 0.2::DOUBLE + (c_custkey % 10) * 0.01::DOUBLE AS top,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 0.04::DOUBLE + (c_custkey % 5) * 0.01::DOUBLE END AS sh, CASE WHEN c_custkey % 17 > 0 THEN c_custkey % 19 > 0 END AS grouped FROM customer),
f AS (SELECT c_custkey, list_filter([CASE WHEN NOT coalesce(n_rungs >= 4, false) THEN 'fewer than 4 rungs' END, CASE WHEN NOT coalesce(dec >= 2.0 - 1e-9, false) THEN 'under 2 decades' END, CASE WHEN NOT coalesce(low > 0, false) THEN 'slope interval reaches 0' END,
  CASE WHEN NOT coalesce(top - 0.2::DOUBLE >= 0.05 - 1e-9, false) THEN 'margin under the bar' END, CASE WHEN NOT coalesce(sh <= 0.04::DOUBLE + 0.02::DOUBLE, false) THEN 'null control above chance' END, CASE WHEN NOT coalesce(grouped, false) THEN 'split is not grouped' END], lambda x: x IS NOT NULL) AS failed FROM c)"""


@query("rd1_fail_closed_clauses", f"WITH {CURVES} SELECT c_custkey, array_to_string(failed, '; ') AS failed, CASE WHEN len(failed) > 0 THEN 'CURVE_NOT_ESTABLISHED' ELSE 'CURVE_ESTABLISHED' END AS verdict FROM f")
def rd1(spark, d):
    return R.RULES["scaling_curve"](curves(spark, d)).select("c_custkey", F.array_join("failed", "; ").alias("failed"), "verdict")


@query("rd2_candidate_screening", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN NOT coalesce(s_acctbal > 0, false) THEN 'balance' END, CASE WHEN NOT coalesce(s_nationkey < 20, false) THEN 'nation' END, CASE WHEN s_suppkey % 4 = 0 THEN 'not measured' END], lambda x: x IS NOT NULL), '; ') AS failed, coalesce(s_acctbal > 0 AND s_nationkey < 20 AND s_suppkey % 4 > 0, false) AS selected FROM supplier")
def rd2(spark, d):
    out = R.screen(read(spark, d, "supplier"), [("balance", F.col("s_acctbal") > 0), ("nation", F.col("s_nationkey") < 20)], F.col("s_suppkey") % 4 > 0)
    return out.select("s_suppkey", F.array_join("failed", "; ").alias("failed"), "selected")


@query("rd3_override", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND (c_acctbal <= 0 OR c_nationkey >= 20) THEN 'REJECT' WHEN c_mktsegment = 'BUILDING' THEN 'SELECT' ELSE 'REVISE' END AS outcome FROM customer")
def rd3(spark, d):
    rec = F.when(F.col("c_mktsegment") == "BUILDING", "SELECT").otherwise("REVISE")
    return read(spark, d, "customer").select("c_custkey", R.override(rec, [("balance", F.col("c_acctbal") > 0), ("nation", F.col("c_nationkey") < 20)]).alias("outcome"))


@query("rd4_three_valued_verdict", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'VOID' WHEN p_retailprice < 1000 THEN 'FAILS' ELSE 'CLEARS' END AS verdict FROM part")
def rd4(spark, d):
    out = R.verdict(read(spark, d, "part"), [("price", F.col("p_retailprice") >= 1000)], "CLEARS", "FAILS", [("size", F.col("p_size") >= 5)])
    return out.select("p_partkey", "verdict")


@query("rd5_recompute_and_compare", f"WITH {scores_sql()}, o AS (SELECT n_units, fam, round(avg(correct::DOUBLE), 4) AS own_accuracy FROM scores GROUP BY 1, 2) SELECT n_units, fam, CASE WHEN fam LIKE '1%' THEN -1.0::DOUBLE ELSE own_accuracy END AS banked_accuracy, own_accuracy FROM o WHERE fam LIKE '1%'")
def rd5(spark, d):
    ours = scores(spark, d).groupBy("n_units", "fam").agg(metrics.accuracy().alias("accuracy"))
    banked = ours.withColumn("accuracy", F.when(F.col("fam").startswith("1"), -1.0).otherwise(F.col("accuracy")))
    return R.recompute(banked, ours, ["n_units", "fam"], ["accuracy"])


@query("rd6_interval_reading", "SELECT o_orderkey, CASE WHEN hi < 0 THEN 'falls' WHEN lo > 0 AND hi < 0.5 THEN 'below_rate' WHEN lo > 0 THEN 'rises' ELSE 'not_resolved' END AS reading FROM (SELECT o_orderkey, (o_custkey % 9 - 4) / 5.0::DOUBLE AS lo, (o_custkey % 9 - 4) / 5.0::DOUBLE + 0.3 AS hi FROM orders)")
def rd6(spark, d):
    lo = (F.col("o_custkey") % 9 - 4) / 5.0
    return read(spark, d, "orders").select("o_orderkey", R.interval_reading(lo, lo + 0.3, 0.5).alias("reading"))


@query("rd7_composite_verdict", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'RISES' ELSE 'FLAT' END || '_' || CASE WHEN o_totalprice > 100000 THEN 'LEADS' ELSE 'TRAILS' END AS verdict FROM orders")
def rd7(spark, d):
    gain, lead = F.when(F.col("o_custkey") % 2 == 0, "RISES").otherwise("FLAT"), F.when(F.col("o_totalprice") > 100000, "LEADS").otherwise("TRAILS")
    return read(spark, d, "orders").select("o_orderkey", R.composite(gain, lead).alias("verdict"))


@query("rd8_coverage_problems", """WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN -p_partkey ELSE p_partkey % 100 + 1 END AS a, p_partkey % 10 AS v, CASE p_partkey % 4 WHEN 0 THEN 'unverifiable' WHEN 1 THEN 'odd' ELSE 'banked' END AS class, CASE WHEN p_partkey % 8 = 0 THEN ' ' ELSE 'why' END AS why FROM part),
x AS (SELECT DISTINCT p_partkey % 100 + 1 AS a, (p_partkey % 100) % 10 AS v FROM part WHERE p_partkey % 100 < 90)
SELECT p_partkey, unnest(list_filter([CASE WHEN x.a IS NULL THEN 'no artifact' END, CASE WHEN x.a IS NOT NULL AND x.v <> e.v THEN 'value differs' END, CASE WHEN class = 'odd' THEN 'unknown class' END, CASE WHEN class = 'unverifiable' AND trim(why) = '' THEN 'no reason' END], lambda q: q IS NOT NULL)) AS problem FROM e LEFT JOIN x ON e.a = x.a""")
def rd8(spark, d):
    k = F.col("p_partkey")
    p = read(spark, d, "part")
    e = p.select("p_partkey", F.when(k % 6 == 0, -k).otherwise(k % 100 + 1).alias("a"), (k % 10).alias("v"), F.when(k % 4 == 0, "unverifiable").when(k % 4 == 1, "odd").otherwise("banked").alias("class"), F.when(k % 8 == 0, " ").otherwise("why").alias("why"))
    x = p.where(k % 100 < 90).select((k % 100 + 1).alias("a"), (k % 100 % 10).alias("v")).distinct()
    return R.coverage_problems(e, x, "p_partkey", "a", "v", ["banked", "unverifiable"])


@query("rd9_document_gate")
def rd9(spark, d):
    tokens = number_tokens(read(spark, d, "documents"), ["doc_id"], "text")
    banked = read(spark, d, "part").select((F.col("p_retailprice") / 100).alias("v"))
    out = joins.backed(tokens, "token", banked, "v")
    return out.where(~F.col("backed")).groupBy("doc_id").agg(F.count("*").alias("n_unbacked"))


@query("rd10_sealed_fields", """SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS sealed, true AS ok FROM events""")
def rd10(spark, d):
    e = read(spark, d, "events").select("event_id", "props", F.sha2(F.regexp_replace("props", r"\s", ""), 256).alias("sealed"))
    return e.select("event_id", "sealed", (F.sha2(canonical_json("props"), 256) == F.col("sealed")).alias("ok"))


@query("vc_count_bar", "SELECT l_suppkey, count(*) AS n, CAST(ceil(count(*) * (1 / 26.0::DOUBLE + 0.05::DOUBLE) - 1e-9) AS BIGINT) AS need, count(*) FILTER (l_returnflag = 'R') AS correct, count(*) FILTER (l_returnflag = 'R') >= ceil(count(*) * (1 / 26.0::DOUBLE + 0.05::DOUBLE) - 1e-9) AS clears FROM lineitem GROUP BY 1")
def vc(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))
    need = R.count_bar(F.col("n"), 1 / 26 + 0.05)
    return g.select("l_suppkey", "n", need.alias("need"), "correct", (F.col("correct") >= need).alias("clears"))


@query("vc_reproduction_and_null", "SELECT p_partkey, abs(p_retailprice - round(p_retailprice)) <= 0.25 AS reproduces, p_size / 100.0::DOUBLE <= 0.1::DOUBLE + 0.02::DOUBLE AND p_partkey % 10 >= 5 AS control FROM part")
def vc2(spark, d):
    return read(spark, d, "part").select("p_partkey", R.reproduces(F.col("p_retailprice"), F.round("p_retailprice"), 0.25).alias("reproduces"), R.null_control(F.col("p_size") / 100.0, 0.1, 0.02, F.col("p_partkey") % 10, 5.0).alias("control"))


@query("vc_sealed_scope", "SELECT o_orderkey, o_orderstatus = 'F' AS ok, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'o_orderstatus is not as sealed' END AS problems FROM orders")
def vc3(spark, d):
    o = read(spark, d, "orders")
    p = R.failed(R.literals(o, {"o_orderstatus": "F"}))
    return o.select("o_orderkey", (F.size(p) == 0).alias("ok"), F.array_join(p, "; ").alias("problems"))
