"""AG1 to AG25."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.portable import sql_hash
from plumbline.operators import metrics as M
from plumbline.operators import splits
from plumbline.plans.inputs import CORPUS, corpus, read, scores, scores_sql
from plumbline.plans.registry import query

SCORES = scores_sql()
R6 = 6


def r6(*names):
    return [F.round(n, R6).alias(n) for n in names]


@query("ag1_accuracy", f"WITH {SCORES} SELECT n_units, round(avg(correct::DOUBLE), 4) AS accuracy FROM scores GROUP BY 1")
def ag1(spark, d):
    return scores(spark, d).groupBy("n_units").agg(M.accuracy().alias("accuracy"))


@query("ag2_family_and_subset", f"""WITH {SCORES} SELECT round(avg(correct::DOUBLE), 4) AS "all", round(avg(correct::DOUBLE) FILTER (fam IN ('1-URGENT', '2-HIGH')), 4) AS acc_top, count(*) FILTER (fam IN ('1-URGENT', '2-HIGH')) AS n_top,
  round(avg(correct::DOUBLE) FILTER (fam IN ('5-LOW')), 4) AS acc_low, count(*) FILTER (fam IN ('5-LOW')) AS n_low FROM scores""")
def ag2(spark, d):
    return M.by_family_and_subset(scores(spark, d), "fam", {"top": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]})


@query("ag3_weighted_recombination", f"WITH {SCORES}, p AS (SELECT n_units, fam, round(avg(correct::DOUBLE), 4) AS acc, count(*) AS n FROM scores GROUP BY 1, 2) SELECT n_units, round(sum(acc * n) / sum(n), 6) AS accuracy FROM p GROUP BY 1")
def ag3(spark, d):
    p = scores(spark, d).groupBy("n_units", "fam").agg(M.accuracy().alias("acc"), F.count("*").alias("n"))
    return p.groupBy("n_units").agg(F.round(M.weighted("acc", "n"), R6).alias("accuracy"))


@query("ag4_dense_histogram", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def ag4(spark, d):
    return M.dense_histogram(read(spark, d, "supplier").where("s_acctbal > 5000"), "s_nationkey", read(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("ag5_majority_class", "SELECT c_nationkey, c_mktsegment AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE k = 1")
def ag5(spark, d):
    return M.majority(read(spark, d, "customer"), "c_mktsegment", ["c_nationkey"])


@query("ag6_label_entropy", "SELECT l_returnflag, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def ag6(spark, d):
    return M.entropy(read(spark, d, "lineitem"), "l_linenumber", ["l_returnflag"]).select("l_returnflag", *r6("entropy"))


@query("ag7_binary_rule", """SELECT p_brand, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(0.5 * (1 + coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0)), 6) AS auc FROM (
  SELECT p_brand, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn FROM (SELECT p_brand, p_size > 20 AS a, p_retailprice > 1000 AS b FROM part) GROUP BY 1)""")
def ag7(spark, d):
    return M.binary_rule(read(spark, d, "part"), F.col("p_size") > 20, F.col("p_retailprice") > 1000, ["p_brand"]).select("p_brand", "tp", "fp", "fn", "tn", *r6("tpr", "fpr", "auc"))


@query("ag8_rank_auc", """WITH e AS (SELECT value AS s, event_type = 'click' AS pos FROM events), r AS (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM e)
SELECT round((sum(r) FILTER (pos) - n * (n + 1) / 2.0) / (n * m), 6) AS auc, n AS n_pos, m AS n_neg FROM r, (SELECT count(*) FILTER (pos) AS n, count(*) FILTER (NOT pos) AS m FROM e) GROUP BY n, m""")
def ag8(spark, d):
    return M.rank_auc(read(spark, d, "events"), "value", F.col("event_type") == "click").select(*r6("auc"), "n_pos", "n_neg")


PAIRS = "m AS (SELECT l_linestatus || l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'OA' WHEN l_discount > 0.05 THEN 'FR' ELSE 'FN' END AS p FROM lineitem)"


def pairs(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.concat("l_linestatus", "l_returnflag").alias("a"), F.when(F.col("l_quantity") > 25, "OA").when(F.col("l_discount") > 0.05, "FR").otherwise("FN").alias("p"))


@query("ag9_macro_f1", f"WITH {PAIRS}, c AS (SELECT a AS k FROM m UNION SELECT p FROM m), f AS (SELECT k, (SELECT count(*) FROM m WHERE a = k AND p = k) AS tp, (SELECT count(*) FROM m WHERE a <> k AND p = k) AS fp, (SELECT count(*) FROM m WHERE a = k AND p <> k) AS fn FROM c) SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS n_classes FROM f")
def ag9(spark, d):
    return M.macro_f1(pairs(spark, d), "p", "a").select(*r6("macro_f1"), "n_classes")


@query("ag10_balanced_accuracy", f"WITH {PAIRS} SELECT round(avg(r), 6) AS balanced_accuracy, count(*) AS n_classes FROM (SELECT a, avg((a = p)::INT) AS r FROM m GROUP BY a)")
def ag10(spark, d):
    return M.balanced_accuracy(pairs(spark, d), "p", "a").select(*r6("balanced_accuracy"), "n_classes")


@query("ag11_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.975), 6) AS p975 FROM lineitem GROUP BY 1")
def ag11(spark, d):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.975)))
    g = read(spark, d, "lineitem").groupBy("l_returnflag").agg(q.alias("q"))
    return g.select("l_returnflag", *[F.round(F.col("q")[i], R6).alias(n) for i, n in enumerate(("median", "p25", "p975"))])


@query("ag12_moments", "SELECT event_type, round(stddev_pop(value), 6) AS sd, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def ag12(spark, d):
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_pop(v), R6).alias("sd"), F.round(F.avg(v), R6).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.round(F.sqrt(F.avg(v * v)), R6).alias("rms"))


@query("ag13_pearson", "SELECT l_linenumber, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r, 0.0::DOUBLE AS r_constant FROM lineitem GROUP BY 1")
def ag13(spark, d):
    li = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return li.groupBy("l_linenumber").agg(F.round(M.pearson("l_quantity", "l_extendedprice"), R6).alias("r"), M.pearson("l_quantity", "one").alias("r_constant"))


@query("ag14_group_mean_fallback", """WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1996-01-01' AS train FROM orders), m AS (SELECT o_custkey, avg(o_totalprice) AS v FROM o WHERE train GROUP BY 1)
SELECT o_orderkey, round(coalesce(v, (SELECT avg(o_totalprice) FROM o WHERE train)), 4) AS expected FROM o LEFT JOIN m USING (o_custkey)""")
def ag14(spark, d):
    o = read(spark, d, "orders")
    return M.with_group_mean(o, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "o_custkey", "o_totalprice", "expected").select("o_orderkey", F.round("expected", 4).alias("expected"))


@query("ag15_median_debias", """WITH e AS (SELECT *, event_id % 10 < 7 AS train FROM events), m AS (SELECT user_id, quantile_cont(value, 0.5) FILTER (train) AS own, quantile_cont(value, 0.5) AS every FROM e GROUP BY 1)
SELECT event_id, round(value - coalesce(own, every), 6) AS residual FROM e JOIN m USING (user_id)""")
def ag15(spark, d):
    return M.debiased(read(spark, d, "events"), F.col("event_id") % 10 < 7, "user_id", "value", "residual").select("event_id", *r6("residual"))


@query("ag16_least_squares", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def ag16(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(*M.fit_line("l_quantity", "l_extendedprice")).select("l_returnflag", *r6("slope", "intercept", "r2"))


@query("ag17_power_law", f"WITH {SCORES}, m AS (SELECT n_units, avg(correct::DOUBLE) AS s FROM scores GROUP BY 1) SELECT round(regr_slope(log10(greatest(1 - s, 1e-6)), log10(n_units)), 6) AS slope, round(regr_intercept(log10(greatest(1 - s, 1e-6)), log10(n_units)), 6) AS intercept FROM m")
def ag17(spark, d):
    m = scores(spark, d).groupBy("n_units").agg(F.avg(F.col("correct").cast("double")).alias("s")).select(F.log10("n_units").alias("x"), M.log_error(F.col("s")).alias("y"))
    return m.agg(*M.fit_line("x", "y")[:2]).select(*r6("slope", "intercept"))


TWO = scores_sql(("model", "tree"))
BY_ROLE = f"{TWO}, a AS (SELECT n_units, round(avg(correct::DOUBLE) FILTER (role = 'model'), 4) AS model, round(avg(correct::DOUBLE) FILTER (role = 'tree'), 4) AS tree FROM scores GROUP BY 1)"


def by_role(spark, d):
    s = scores(spark, d, ("model", "tree"))
    return s.groupBy("n_units").pivot("role", ["model", "tree"]).agg(M.accuracy())


@query("ag18_margins", f"WITH {BY_ROLE} SELECT n_units, model, tree, round(model - tree, 4) AS margin, round(model - tree, 4) >= 0.04 AS clears, round(round(model - tree, 4) - 0.04, 4) AS distance FROM a")
def ag18(spark, d):
    return M.margins(by_role(spark, d), "model", "tree", 0.04)


@query("ag19_best_baseline", "WITH s AS (SELECT p_brand, p_size, p_partkey, round(p_retailprice / 100) AS s FROM part) SELECT p_brand, p_partkey AS best, s AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS k FROM s) WHERE k = 1")
def ag19(spark, d):
    p = read(spark, d, "part").withColumn("s", F.round(F.col("p_retailprice") / 100))
    return M.best_listed(p, ["p_brand"], "s", "p_partkey", "p_partkey")


@query("ag20_floored_bar", "WITH s AS (SELECT s_nationkey, s_suppkey, round(s_acctbal / 1000) AS raw FROM supplier) SELECT s_nationkey, s_suppkey AS head, bar, raw FROM (SELECT *, greatest(raw, 5) AS bar, row_number() OVER (PARTITION BY s_nationkey ORDER BY greatest(raw, 5) DESC, raw DESC, s_suppkey DESC) AS k FROM s) WHERE k = 1")
def ag20(spark, d):
    s = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 1000).alias("raw"), F.lit(5.0).alias("floor"))
    return M.floored_bar(s, ["s_nationkey"], "raw", "floor", "s_suppkey")


@query("ag21_digest", "SELECT p_partkey, substr(sha256('p_brand=' || p_brand || chr(10) || 'p_size=' || p_size), 1, 16) AS digest FROM part")
def ag21(spark, d):
    return read(spark, d, "part").select("p_partkey", M.short_digest("p_size", "p_brand").alias("digest"))


@query("ag22_weakest_first", "WITH d(c, place) AS (VALUES ('P', 0), ('O', 1), ('F', 2), ('X', 3)) SELECT c AS status, place, count(o_orderkey) AS n FROM d LEFT JOIN orders ON o_orderstatus = c GROUP BY 1, 2 ORDER BY place")
def ag22(spark, d):
    dim = spark.createDataFrame([("P", 0), ("O", 1), ("F", 2), ("X", 3)], "status string, place int")
    return M.dense_histogram(read(spark, d, "orders"), "o_orderstatus", dim, "status").join(dim, "status").select("status", "place", "n").orderBy("place")


@query("ag23_dated_headings", """WITH l AS (SELECT source, unnest(string_split('# ' || strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d') || ' note' || chr(10) || text, chr(10))) AS l FROM documents)
SELECT source, count(*) AS n, min(regexp_extract(l, '^# (\\d{4}-\\d{2}-\\d{2})', 1)) AS first, max(regexp_extract(l, '^# (\\d{4}-\\d{2}-\\d{2})', 1)) AS last FROM l WHERE regexp_matches(l, '^# \\d{4}-\\d{2}-\\d{2}') GROUP BY 1""".replace("\\\\", "\\"))
def ag23(spark, d):
    from plumbline.functions.textnum import dated_headings

    t = read(spark, d, "documents")
    head = F.concat(F.lit("# "), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd"), F.lit(" note\n"), F.col("text"))
    return dated_headings(t.select("source", head.alias("text")), ["source"], "text")


@query("ag24_cost_by_prefix", "SELECT substr(p_type, 1, 3) AS prefix, round(sum(p_retailprice), 2) AS cost, count(*) AS n FROM part WHERE p_type LIKE 'S%' GROUP BY 1")
def ag24(spark, d):
    return read(spark, d, "part").where(F.col("p_type").startswith("S")).groupBy(F.left("p_type", F.lit(3)).alias("prefix")).agg(F.round(F.sum("p_retailprice"), 2).alias("cost"), F.count("*").alias("n"))


@query("ag25_null_ceiling", f"""WITH {CORPUS}, o AS (SELECT g, row_number() OVER (ORDER BY {sql_hash('7', 'g')}, g) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM corpus)),
p AS (SELECT *, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'eval' ELSE 'train' END AS part FROM corpus JOIN o USING (g)),
t AS (SELECT y AS top FROM corpus GROUP BY y ORDER BY count(*) DESC, y LIMIT 4),
b AS (SELECT top, avg((y = top)::INT) FILTER (part = 'train') > 0.5 AS guess FROM p, t GROUP BY 1)
SELECT round(max(a), 6) AS ceiling FROM (SELECT top, avg(((y = top) = guess)::INT) AS a FROM p JOIN b ON true WHERE part = 'eval' GROUP BY 1)""")
def ag25(spark, d):
    c = splits.grouped_split(corpus(spark, d), "g", 0.2, 7)
    top = c.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(4).select(F.col("y").alias("top"))
    each = c.crossJoin(F.broadcast(top)).withColumn("hit", (F.col("y") == F.col("top")).cast("int"))  # four rows
    guess = each.where("part = 'train'").groupBy("top").agg((F.avg("hit") > 0.5).cast("int").alias("guess"))
    return each.where("part = 'eval'").join(guess, "top").groupBy("top").agg(F.avg((F.col("hit") == F.col("guess")).cast("int")).alias("a")).agg(F.round(F.max("a"), R6).alias("ceiling"))
