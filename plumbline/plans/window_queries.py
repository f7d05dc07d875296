"""WN1 to WN11, ST1 to ST6, SO1 to SO5."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import windows as W
from plumbline.operators.joins import union_offset
from plumbline.operators.splits import doublings
from plumbline.plans.inputs import CORPUS, corpus, read
from plumbline.plans.registry import query
from plumbline.plans.split_queries import SEED, order_sql


@query("wn1_group_ordinal", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def wn1(spark, d):
    return W.ordinal(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", F.col("ordinal").cast("long").alias("ordinal"))


RUNS = """m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)"""


@query("wn2_run_lengths", f"WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length FROM r GROUP BY 1, 2, 3")
def wn2(spark, d):
    return W.run_lengths(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("wn3_first_appearance", f"WITH {CORPUS} SELECT fam, g, min(pool_pos) AS first, row_number() OVER (PARTITION BY fam ORDER BY min(pool_pos), g) AS place FROM corpus GROUP BY fam, g")
def wn3(spark, d):
    return W.first_appearance(corpus(spark, d), ["fam"], "g", "pool_pos")


@query("wn4_differences", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS gain FROM events")
def wn4(spark, d):
    return W.differences(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("gain", 6).alias("gain"))


@query("wn5_stall", "SELECT l_suppkey, l_orderkey, l_linenumber, count(l_returnflag) OVER w = 4 AND min(l_returnflag) OVER w = max(l_returnflag) OVER w AS stalled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def wn5(spark, d):
    return W.stalled(read(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag").select("l_suppkey", "l_orderkey", "l_linenumber", "stalled")


@query("wn6_hash_chain", """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS seq, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS body FROM lineitem),
h AS (SELECT *, sha256('0|' || seq || '|' || body) AS own0 FROM l), b AS (SELECT *, CASE WHEN seq = 0 THEN repeat('0', 64) ELSE lag(own0) OVER (PARTITION BY l_orderkey ORDER BY seq) END AS prev0 FROM h),
c AS (SELECT l_orderkey, seq, body, CASE WHEN l_orderkey % 97 = 0 AND seq = 1 THEN 'x' ELSE prev0 END AS prev, CASE WHEN seq = 0 THEN sha256(repeat('0', 64) || '|0|' || body) ELSE own0 END AS own FROM b)
SELECT l_orderkey, seq, true AS seq_ok, prev = coalesce(lag(own) OVER (PARTITION BY l_orderkey ORDER BY seq), repeat('0', 64)) AS prev_ok, own = sha256(prev || '|' || seq || '|' || body) AS hash_ok FROM c""")
def wn6(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")
    li = read(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("l_quantity").cast("long").cast("string").alias("body"))
    h = li.withColumn("own0", W.link_hash(F.lit("0"), F.col("seq"), F.col("body")))
    v = Window.partitionBy("l_orderkey").orderBy("seq")
    prev = F.when((F.col("l_orderkey") % 97 == 0) & (F.col("seq") == 1), "x").otherwise(F.lag("own0", 1, W.GENESIS).over(v))
    c = h.withColumn("prev", prev).withColumn("own", F.when(F.col("seq") == 0, W.link_hash(F.lit(W.GENESIS), F.col("seq"), F.col("body"))).otherwise(F.col("own0")))
    return W.verify_chain(c, "seq", "body", "prev", "own", ["l_orderkey"])


@query("wn7_nested_steps", f"""WITH {CORPUS}, {order_sql('g', 'corpus', 'fam')}, m AS (SELECT step, g FROM ranked, range(0, 3) s(step) WHERE r <= 2 * pow(2, step))
SELECT CAST(step AS INTEGER) AS step, count(*) AS n_groups, 0 AS n_missing, coalesce(count(*) > lag(count(*)) OVER (ORDER BY step), true) AS grew FROM m GROUP BY step""")
def wn7(spark, d):
    out = W.nested_check(doublings(corpus(spark, d), "fam", "g", SEED, 2, 3), "step", "g")
    return out.withColumn("n_missing", F.col("n_missing").cast("int"))


LEDGER = "CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'click' THEN 'started' ELSE 'beat' END"


def ledger(spark, d):
    e = F.col("event_type")
    return read(spark, d, "events").withColumn("event", F.when(e == "purchase", "completed").when(e == "click", "started").otherwise("beat"))


@query("wn8_open_attempts", f"SELECT user_id, count(*) FILTER (e = 'started') AS n_started, count(*) FILTER (e = 'completed') AS n_completed, count(*) FILTER (e = 'started') > count(*) FILTER (e = 'completed') AS open, count(*) FILTER (e = 'completed') = 1 AS completed_once FROM (SELECT user_id, {LEDGER} AS e FROM events) GROUP BY 1")
def wn8(spark, d):
    return W.attempts(ledger(spark, d), ["user_id"], "event")


@query("wn8b_starts_since_terminal", f"""WITH e AS (SELECT user_id, ts, event_id, {LEDGER} AS e FROM events), t AS (SELECT user_id, max((ts, event_id)) AS last FROM e WHERE e = 'completed' GROUP BY 1)
SELECT user_id, count(*) FILTER (e = 'started' AND (last IS NULL OR (ts, event_id) > last)) AS n_open_starts FROM e LEFT JOIN t USING (user_id) GROUP BY 1""")
def wn8b(spark, d):
    return W.starts_since_terminal(ledger(spark, d), ["user_id"], ["ts", "event_id"], "event", ["completed"])


@query("wn9_autocorrelation", "WITH s AS (SELECT event_type, value AS x, " + ", ".join(f"lag(value, {k}) OVER w AS x{k}" for k in (1, 2, 3, 4, 8, 16, 32, 64)) + " FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, " + ", ".join(f"round(coalesce(corr(x, x{k}), 0), 6) AS ac_{k}" for k in (1, 2, 3, 4, 8, 16, 32, 64)) + " FROM s GROUP BY 1")
def wn9(spark, d):
    lags = [1, 2, 3, 4, 8, 16, 32, 64]
    out = W.autocorrelation(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", lags)
    return out.select("event_type", *[F.round(f"ac_{k}", 6).alias(f"ac_{k}") for k in lags])


@query("wn10_batch_order", "WITH f AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS f, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT o_orderkey, CAST(before + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS place FROM orders JOIN b USING (o_custkey)")
def wn10(spark, d):
    return W.batch_order(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "place")


@query("wn11_expand_runs", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type FROM events")
def wn11(spark, d):
    runs = W.run_lengths(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return W.expand_runs(runs, ["user_id"], "run", "length", "event_type")


@query("st1_lexsort", f"WITH {CORPUS} SELECT g, y, row_id FROM corpus ORDER BY g, y, row_id")
def st1(spark, d):
    return corpus(spark, d).select("g", "y", "row_id").orderBy("g", "y", "row_id")


@query("st2_stable_argsort", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
def st2(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_size").orderBy("p_size", "p_partkey")


@query("st3_top_and_bottom_share", """SELECT 'top' AS side, c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= greatest(1, floor(n * 10 / 100))
UNION ALL SELECT 'bottom', c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= greatest(1, floor(n * 10 / 100))""")
def st3(spark, d):
    c = read(spark, d, "customer")
    side = lambda name, high: W.top_share(c, ["c_nationkey"], "c_acctbal", "c_custkey", 10, high).select(F.lit(name).alias("side"), "c_nationkey", "c_custkey")
    return side("top", True).unionAll(side("bottom", False))


@query("st4_most_common", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 4")
def st4(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(4)


@query("st5_staged_selection", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS s FROM a WHERE r <= 12)
SELECT p_brand, p_partkey FROM b WHERE s <= 3""")
def st5(spark, d):
    return W.staged_selection(read(spark, d, "part"), ["p_brand"], [("p_retailprice", 12), ("p_size", 3)], "p_partkey").select("p_brand", "p_partkey")


@query("st6_least_flattering", "SELECT o_custkey, arg_min(o_orderpriority, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority)) AS worst FROM orders GROUP BY 1")
def st6(spark, d):
    return W.worst_reading(read(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])


@query("so1_union_offset", "SELECT s_suppkey AS row_id, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer")
def so1(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("v"))
    b = read(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("v"))
    return union_offset([a, b], "row_id", [0, 1_000_000])


@query("so2_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def so2(spark, d):
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(read(spark, d, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("so3_except", "SELECT p_size AS k FROM part WHERE p_brand = 'Brand#11' EXCEPT SELECT p_size FROM part WHERE p_brand = 'Brand#22'")
def so3(spark, d):
    p = read(spark, d, "part")
    return p.where("p_brand = 'Brand#11'").select(F.col("p_size").alias("k")).subtract(p.where("p_brand = 'Brand#22'").select("p_size"))


@query("so4_subset_test", "SELECT count(*) AS n_outside, count(*) = 0 AS subset FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))")
def so4(spark, d):
    out = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(read(spark, d, "part"), "p_partkey", "left_anti")
    return out.agg(F.count("*").alias("n_outside")).withColumn("subset", F.col("n_outside") == 0)


@query("so5_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def so5(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
