"""JN1 to JN15."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.portable import sql_hash
from plumbline.operators import joins as J
from plumbline.plans.inputs import CORPUS, PREDICTIONS, corpus, predictions, read
from plumbline.plans.registry import query


@query("jn1_lookup_fallback", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def jn1(spark, d):
    n = read(spark, d, "nation").withColumn("own", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))).withColumnRenamed("n_regionkey", "r_regionkey")
    return J.lookup(n, read(spark, d, "region"), "r_regionkey", "own", "r_name", "label").select("n_nationkey", "label")


@query("jn2_composite_equi_join", "SELECT l_orderkey, l_linenumber, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) k USING (l_partkey, l_suppkey)")
def jn2(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    keys = li.where("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    return li.join(keys, ["l_partkey", "l_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("jn3_asof_backward", """WITH p AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_id % 2 = 0),
r AS (SELECT event_id AS rec_id, user_id, epoch(ts) AS rt, value FROM events WHERE event_id % 2 = 1)
SELECT event_id, user_id, rec_id, value FROM (SELECT p.event_id, p.user_id, r.rec_id, r.value, row_number() OVER (PARTITION BY p.event_id ORDER BY r.rt DESC, r.rec_id DESC) AS k, p.t - r.rt AS age
  FROM p JOIN r ON p.user_id = r.user_id AND r.rt <= p.t) WHERE k = 1 AND age <= 14400 AND value > 10""")
def jn3(spark, d):
    e = read(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    points = e.where("event_id % 2 = 0").select("event_id", "user_id", "t")
    records = e.where("event_id % 2 = 1").select(F.col("event_id").alias("rec_id"), "user_id", F.col("t").alias("rt"), "value")
    return J.asof(points, records, "user_id", "t", "rt", 14400.0, "rec_id", F.col("value") > 10).select("event_id", "user_id", "rec_id", "value")


@query("jn4_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large FROM customer")
def jn4(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_totalprice > 300000")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o, on, "left_semi").withColumn("has_large", F.lit(True)).unionAll(c.join(o, on, "left_anti").withColumn("has_large", F.lit(False)))


@query("jn5_shared_keys", "SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R') AS n_left, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_discount > 0.09) AS n_right, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)) AS n_shared")
def jn5(spark, d):
    li = read(spark, d, "lineitem")
    return J.shared_keys(li.where("l_returnflag = 'R'"), li.where("l_discount > 0.09"), "l_suppkey")


@query("jn6_hash_membership", "SELECT o_orderkey FROM orders WHERE md5(CAST(o_custkey AS VARCHAR)) IN (SELECT md5(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal < 0)")
def jn6(spark, d):
    o = read(spark, d, "orders").withColumn("h", F.md5(F.col("o_custkey").cast("string")))
    c = read(spark, d, "customer").where("c_acctbal < 0").select(F.md5(F.col("c_custkey").cast("string")).alias("h"))
    return o.join(c, "h", "left_semi").select("o_orderkey")


@query("jn7_content_match", "WITH s AS (SELECT text, min(doc_id) AS matched, count(*) AS n_matches FROM documents WHERE doc_id % 2 = 0 GROUP BY text) SELECT doc_id, matched, n_matches FROM documents JOIN s USING (text) WHERE doc_id % 2 = 1")
def jn7(spark, d):
    t = read(spark, d, "documents").select("doc_id", "text")
    return J.content_matches(t.where("doc_id % 2 = 1"), t.where("doc_id % 2 = 0"), ["text"], "doc_id", "doc_id")


@query("jn8_band_match", f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) || '.' || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0') AS token FROM lineitem),
b AS (SELECT c_acctbal / 100 AS v FROM customer), c AS (SELECT v AS x FROM b UNION ALL SELECT v * 100 FROM b UNION ALL SELECT v / 100 FROM b)
SELECT l_orderkey, l_linenumber, token, round(CAST(token AS DOUBLE), 12) IN (SELECT round(round(x, 2), 12) FROM c) AS backed FROM t""")
def jn8(spark, d):
    li = read(spark, d, "lineitem")
    t = li.select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("."), F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0")).alias("token"))
    return J.backed(t, "token", read(spark, d, "customer").select((F.col("c_acctbal") / 100).alias("v")), "v").select("l_orderkey", "l_linenumber", "token", "backed")


@query("jn9_equal_pairs", "WITH f AS (SELECT text, min(doc_id) AS first, count(*) AS n_class FROM documents GROUP BY text HAVING count(*) > 1) SELECT first, doc_id AS copy, n_class FROM documents JOIN f USING (text) WHERE doc_id > first")
def jn9(spark, d):
    return J.equal_pairs(J.with_digest(read(spark, d, "documents").select("doc_id", "text"), ["text"]), "digest", "doc_id")


@query("jn10_first_match", "WITH c AS (SELECT p_brand, p_size, min(p_partkey) AS decoded, count(*) AS n_matches FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2) SELECT p_partkey, decoded, coalesce(n_matches, 0) AS n_matches, coalesce(n_matches, 0) > 1 AS tie FROM part LEFT JOIN c USING (p_brand, p_size) WHERE p_partkey % 3 = 0")
def jn10(spark, d):
    p = J.with_digest(read(spark, d, "part"), ["p_brand", "p_size"])
    return J.match_first(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 3 > 0"), "digest", "p_partkey", "p_partkey")


@query("jn11_nearest_neighbour", f"""WITH {CORPUS}, t AS (SELECT row_id, y, features::DOUBLE[] AS f FROM corpus WHERE row_id % 10 > 0), p AS (SELECT row_id, features::DOUBLE[] AS f FROM corpus WHERE row_id % 10 = 0)
SELECT row_id, neighbour, label FROM (SELECT p.row_id, t.row_id AS neighbour, t.y AS label, row_number() OVER (PARTITION BY p.row_id ORDER BY list_distance(p.f, t.f), t.row_id) AS k FROM p, t) WHERE k = 1""")
def jn11(spark, d):
    c = corpus(spark, d)
    return J.nearest(c.where("row_id % 10 = 0"), c.where("row_id % 10 > 0"), "row_id", "features", "y").select("row_id", "neighbour", F.col("label").cast("int").alias("label"))


@query("jn12_key_compare", "WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END AS v FROM nation WHERE n_nationkey > 4) SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL")
def jn12(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return J.compare_keys(n.where("k < 20"), n.where("k > 4").withColumn("v", F.when(F.col("k") % 7 != 0, F.col("v"))), "k", "v").select("k", "left_value", "right_value", "in_left", "in_right")


@query("jn13_positional_zip", "SELECT vec_id, pos, embedding[pos + 1] AS a, CASE WHEN pos < 32 THEN embedding[64 - pos] END AS b FROM embeddings, range(0, 64) r(pos)")
def jn13(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.slice(F.reverse("embedding"), 1, 32).alias("b"))
    return J.zipped(e, ["vec_id"], ["a", "b"])


@query("jn14_stitch", f"WITH {CORPUS}, {PREDICTIONS} SELECT row_id, fam, p FROM corpus JOIN predictions USING (row_id) WHERE fam = 'f' || CAST(class AS VARCHAR)")
def jn14(spark, d):
    folds = predictions(spark, d).withColumn("fold", F.concat(F.lit("f"), F.col("class").cast("string")))
    return J.stitch(corpus(spark, d).select("row_id", "fam"), folds, "row_id", "fam", "fold", "p").select("row_id", "fam", "p")


@query("jn15_alignment", f"SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 < 4) AS n_left, (SELECT count(*) FROM orders WHERE {sql_hash('3', 'o_orderkey')} % 4 > 0) AS n_right, (SELECT count(*) FROM orders WHERE (o_orderkey % 5 < 4) <> ({sql_hash('3', 'o_orderkey')} % 4 > 0)) AS n_unmatched")
def jn15(spark, d):
    from plumbline.functions.portable import draw

    o = read(spark, d, "orders").select("o_orderkey")
    return J.aligned(o.where("o_orderkey % 5 < 4"), o.where(draw(4, 3, "o_orderkey") > 0), ["o_orderkey"])
