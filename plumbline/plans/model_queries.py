"""ML1 to ML8."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.portable import sql_hash
from plumbline.operators import metrics
from plumbline.operators import models as M
from plumbline.operators import rules as R
from plumbline.plans.inputs import CORPUS, corpus, read
from plumbline.plans.registry import query


def train():
    return F.col("g") >= 12


@query("ml1_trivial_baselines")
def ml1(spark, d):
    return M.trivial_baselines(corpus(spark, d), train(), "row_id", "features", "y", 7)


@query("ml1b_majority_floor", f"""WITH {CORPUS}, m AS (SELECT y FROM corpus WHERE g >= 12 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT round(avg((c.y = m.y)::INT::DOUBLE), 4) AS accuracy, round(round(avg((c.y = m.y)::INT::DOUBLE), 4) + 0.05, 4) AS floor FROM corpus c, m WHERE g < 12""")
def ml1b(spark, d):
    c = corpus(spark, d)
    top = metrics.majority(c.where(train()).withColumn("one", F.lit(1)), "y", ["one"]).select("majority")
    a = c.where(~train()).crossJoin(F.broadcast(top)).agg(F.round(F.avg((F.col("y") == F.col("majority")).cast("double")), 4).alias("accuracy"))  # one row
    return a.withColumn("floor", F.round(F.col("accuracy") + 0.05, 4))


@query("ml1c_stratified_guess", f"""WITH {CORPUS}, n AS (SELECT y, sum(count(*)) OVER (ORDER BY y) AS upto, sum(count(*)) OVER () AS total FROM corpus WHERE g >= 12 GROUP BY y)
SELECT row_id, min(n.y) AS guess FROM corpus c JOIN n ON n.upto > {sql_hash('7', 'row_id')} % total WHERE g < 12 GROUP BY 1""")
def ml1c(spark, d):
    return M.stratified_guess(corpus(spark, d), train(), "row_id", "y", 7)


@query("ml2_extended_baselines")
def ml2(spark, d):
    b = M.trivial_baselines(corpus(spark, d), train(), "row_id", "features", "y", 7, extended=True)
    frozen = b.where(~F.col("name").isin("depth-8", "depth-16")).withColumn("set", F.lit("frozen"))
    return metrics.best_listed(frozen.unionByName(b.withColumn("set", F.lit("expanded"))), ["set"], "accuracy", "listing", "name")


@query("ml3_main_model")
def ml3(spark, d):
    c = corpus(spark, d)
    valid = F.col("g") % 10 == 0
    classes = [r["y"] for r in c.select("y").distinct().orderBy("y").collect()]  # a short list
    models = M.boosted_with_validation(c.where(train() & ~valid), c.where(train() & valid), "features", "y", classes, maxIter=4, maxDepth=2, seed=7)
    p = M.predicted_by_class(models, c.where(~train()), "row_id", "features")
    return c.where(~train()).join(p, "row_id").agg(F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))


#: Small settings, one for each family of the registry.
SETTINGS = {"tree": {"maxDepth": 3}, "logistic": {"maxIter": 10}, "forest": {"numTrees": 5, "seed": 7}, "boosted": {"maxIter": 2, "maxDepth": 2, "seed": 7}}


@query("ml4_estimator_registry")
def ml4(spark, d):
    c, out = corpus(spark, d), None
    for family in sorted(SETTINGS):
        p = M.predicted(M.fitted(c.where(train()), family, "features", "y", **SETTINGS[family]), c.where(~train()), "row_id", "features")
        one = c.where(~train()).join(p, "row_id").agg(F.lit(family).alias("family"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 4).alias("accuracy"))
        out = one if out is None else out.unionAll(one)
    return out


@query("ml5_recipe_search")
def ml5(spark, d):
    c = corpus(spark, d)
    roster = [("logistic-0.0", "logistic", {"maxIter": 20}), ("logistic-0.1", "logistic", {"maxIter": 20, "regParam": 0.1}), ("tree-4", "tree", {"maxDepth": 4}), ("forest-10", "forest", {"numTrees": 10, "seed": 7})]
    return M.search(c.where(train() & (F.col("g") % 10 > 0)), c.where(train() & (F.col("g") % 10 == 0)), "row_id", "features", "y", roster)


@query("ml7_single_feature_rule", "SELECT round(0.5 * (1 + tp / (tp + fn) - fp / (fp + tn)), 6) AS auc FROM (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn FROM (SELECT l_quantity > 30 AS a, l_returnflag = 'R' AS b FROM lineitem))")
def ml7(spark, d):
    return metrics.binary_rule(read(spark, d, "lineitem"), F.col("l_quantity") > 30, F.col("l_returnflag") == "R").select(F.round("auc", 6).alias("auc"))


@query("ml8_probabilities")
def ml8(spark, d):
    c = corpus(spark, d)
    m = M.fitted(c.where(train()), "logistic", "features", "y", maxIter=20)
    p = M.predicted(m, c.where(~train()), "row_id", "features", probability=True)
    return p.select("row_id", "prediction", F.posexplode("probability").alias("class", "p"))


@query("ud1_extension_points", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'RICH' ELSE 'POOR' END AS verdict, 0 AS guess, 'own' || CAST(s_suppkey % 3 AS VARCHAR) AS fam FROM supplier")
def ud1(spark, d):
    """A caller's rule set, estimator and generator, used through the same registries."""

    class Constant:
        def fit(self, rows):
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(0.0))

    R.RULES["callers_rule"] = lambda df: R.verdict(df, [("balance", F.col("s_acctbal") > 5000)], "RICH", "POOR")
    M.ESTIMATORS["callers_constant"] = lambda **p: Constant()
    generators = {i: (lambda key, i=i: F.concat(F.lit("own"), F.lit(str(i)))) for i in range(3)}
    s = read(spark, d, "supplier").withColumn("v", F.array("s_acctbal"))
    guess = M.predicted(M.fitted(s.withColumn("y", F.lit(0)), "callers_constant", "v", "y"), s, "s_suppkey", "v")
    fam = F.coalesce(*[F.when(F.col("s_suppkey") % 3 == i, g("s_suppkey")) for i, g in generators.items()])
    out = R.RULES["callers_rule"](s).join(guess, "s_suppkey")
    return out.select("s_suppkey", "verdict", F.col("prediction").alias("guess"), fam.alias("fam"))
