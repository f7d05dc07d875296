"""BS1 to BS14."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import resampling as B
from plumbline.plans.inputs import PREDICTIONS, predictions, read, score_cells, scores, scores_sql
from plumbline.plans.registry import query

#: Fixed value: resamples of an interval.
N_BOOT = 2000
ROLES = ("model", "tree")


def mixed_sql(name: str, keys: str, start: str, source: str) -> str:
    """A WITH part of `keys` and h, the 32-bit mix of an expression over the source."""
    last, parts = f"{name}0", [f"{name}0 AS (SELECT {keys}, CAST({start} AS UBIGINT) & 4294967295 AS h FROM {source})"]
    steps = ["xor(h, h >> 16)", f"(h * {0x85EBCA6B}) & 4294967295", "xor(h, h >> 13)", f"(h * {0xC2B2AE35}) & 4294967295", "xor(h, h >> 16)"]
    for k, step in enumerate(steps, 1):
        new = name if k == len(steps) else f"{name}{k}"
        parts.append(f"{new} AS (SELECT * REPLACE ({step} AS h) FROM {last})")
        last = new
    return ",\n".join(parts)


def sql(roles=("model",), by="role, n_units", cluster="g", seeds=(0,)) -> str:
    """WITH parts: scores, per-cluster sums, draws, resampled means."""
    asked = f"(SELECT unnest([{', '.join(map(str, seeds))}]) AS seed), range(0, {N_BOOT}) x(b)"
    return f"""{scores_sql(roles)}, sums AS (SELECT {cluster} AS k, {by}, sum(correct::DOUBLE) AS s, count(*) AS c FROM scores GROUP BY ALL),
num AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM sums)),
{mixed_sql('resample', 'seed, b', f'seed * {B.SEED_STEP} + b', asked)},
{mixed_sql('slot', 'idx, n', f'idx + {B.SLOT_STEP}', 'num')},
{mixed_sql('pick', 'seed, b, n', 'xor(resample.h, slot.h)', 'resample, slot')},
picked AS (SELECT seed, b, CAST((h * n::UBIGINT) >> 32 AS BIGINT) AS idx, count(*) AS m FROM pick GROUP BY ALL),
means AS (SELECT seed, b, {by}, sum(s * m) / sum(c * m) AS mean FROM picked JOIN num USING (idx) JOIN sums USING (k) GROUP BY ALL)"""


SLOPES = ", slopes AS (SELECT seed, b, role, regr_slope(mean, log10(n_units)) AS slope, regr_slope(log10(greatest(1 - mean, 1e-6)), log10(n_units)) AS error_slope FROM means GROUP BY ALL)"
CI = "round(quantile_cont({0}, 0.025), 6) AS ci_low, round(quantile_cont({0}, 0.975), 6) AS ci_high"


def rounded(df, *exact):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else c for c, t in df.dtypes])


PERM = """, r AS (SELECT row_number() OVER (ORDER BY n_units) AS i, log10(n_units) AS x, mean AS y FROM (SELECT n_units, avg(correct::DOUBLE) AS mean FROM scores WHERE role = 'model' GROUP BY 1)),
o AS (SELECT a.y AS y1, b.y AS y2, c.y AS y3, d.y AS y4, row_number() OVER () AS k FROM r a, r b, r c, r d WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND b.i <> c.i AND b.i <> d.i AND c.i <> d.i),
ps AS (SELECT k, regr_slope(CASE i WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 ELSE y4 END, x) AS slope FROM o, r GROUP BY k),
perm AS (SELECT count(*) AS n_permutations, round(avg((slope >= (SELECT regr_slope(y, x) FROM r) - 1e-12)::INT), 6) AS p_value FROM ps)"""


@query("bs1_scaling_fit", f"""WITH {sql()}{SLOPES}{PERM}, f AS (SELECT count(*) AS n_rungs, round(max(x) - min(x), 6) AS decades, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2,
  round(regr_slope(log10(greatest(1 - y, 1e-6)), x), 6) AS error_slope, round(regr_intercept(log10(greatest(1 - y, 1e-6)), x), 6) AS error_intercept, round(regr_r2(log10(greatest(1 - y, 1e-6)), x), 6) AS error_r2 FROM r),
c AS (SELECT {CI.format('slope')}, round(quantile_cont(error_slope, 0.025), 6) AS error_ci_low, round(quantile_cont(error_slope, 0.975), 6) AS error_ci_high FROM slopes)
SELECT n_rungs, decades, (SELECT count(*) FROM orders) AS eval_size, CAST(NULL AS VARCHAR) AS refused, slope, intercept, r2, error_slope, error_intercept, error_r2, ci_low, ci_high, error_ci_low, error_ci_high, n_permutations, p_value, ci_low > 0 AS positive_slope_survives FROM f, c, perm""")
def bs1(spark, d):
    return rounded(B.scaling_fit(scores(spark, d), "g", N_BOOT, 0))


@query("bs2_cluster_bootstrap", f"WITH {sql()}{SLOPES} SELECT b, round(slope, 6) AS slope, round(error_slope, 6) AS error_slope FROM slopes")
def bs2(spark, d):
    return rounded(B.bootstrap_slopes(scores(spark, d), "g", [], N_BOOT, [0]).drop("seed")).withColumn("b", F.col("b").cast("long"))


@query("bs3_example_bootstrap", f"WITH {sql(cluster='row_id')}{SLOPES} SELECT {CI.format('slope')}, count(*) AS n FROM slopes")
def bs3(spark, d):
    return rounded(B.bootstrap_slopes(scores(spark, d), "row_id", [], N_BOOT, [0]).agg(*B.interval("slope"), F.count("*").alias("n")))


@query("bs4_permutation_test", f"WITH {scores_sql()}{PERM} SELECT n_permutations, p_value FROM perm")
def bs4(spark, d):
    m = scores(spark, d).groupBy("n_units").agg(F.avg(F.col("correct").cast("double")).alias("mean")).withColumn("x", F.log10("n_units"))
    return rounded(B.permutation_p(m, "x", "mean"))


@query("bs5_percentile_interval", f"SELECT event_type, {CI.format('value')} FROM events GROUP BY 1")
def bs5(spark, d):
    return rounded(read(spark, d, "events").groupBy("event_type").agg(*B.interval("value")))


@query("bs6_rounded_slopes", f"WITH {sql(ROLES)}, s AS (SELECT b, role, regr_slope(round(mean, 4), log10(n_units)) AS slope FROM means GROUP BY ALL) SELECT role, round(avg(slope), 4) AS slope, round(quantile_cont(slope, 0.025), 4) AS ci_low, round(quantile_cont(slope, 0.975), 4) AS ci_high FROM s GROUP BY 1")
def bs6(spark, d):
    s = B.bootstrap_slopes(score_cells(spark, d, ROLES), "g", ["role"], N_BOOT, [0], 4)
    out = s.groupBy("role").agg(F.avg("slope").alias("slope"), *B.interval("slope"))
    return out.select("role", *[F.round(c, 4).alias(c) for c in ("slope", "ci_low", "ci_high")])  # a mean at a rounding edge may differ by engine


LEAD = "d AS (SELECT seed, n_units, b, max(mean) FILTER (role = 'model') - max(mean) FILTER (role = 'tree') AS d FROM means GROUP BY ALL)"


@query("bs7_paired_lead", f"WITH {sql(ROLES)}, {LEAD} SELECT n_units, round(avg(d), 6) AS lead, {CI.format('d')}, round(avg((d > 0)::INT), 6) AS share_above FROM d GROUP BY 1")
def bs7(spark, d):
    m = B.resampled_means(score_cells(spark, d, ROLES), "g", ["role", "n_units"], N_BOOT, [0])
    return rounded(B.lead(m, "role", "model", "tree", ["n_units"]))


@query("bs8_mean_interval", f"WITH {sql(ROLES)} SELECT role, n_units, {CI.format('mean')} FROM means GROUP BY 1, 2")
def bs8(spark, d):
    m = B.resampled_means(score_cells(spark, d, ROLES), "g", ["role", "n_units"], N_BOOT, [0])
    return rounded(m.groupBy("role", "n_units").agg(*B.interval("mean")))


SEEDS = tuple(range(20))


@query("bs9_seed_stability", f"WITH {sql(ROLES, seeds=SEEDS)}, {LEAD}, i AS (SELECT seed, n_units, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1, 2), v AS (SELECT n_units, seed, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'not_resolved' END AS v FROM i) SELECT n_units, count(*) AS n_seeds, count(DISTINCT v) AS n_readings, count(*) FILTER (v <> first) AS n_disagree FROM (SELECT *, arg_min(v, seed) OVER (PARTITION BY n_units) AS first FROM v) GROUP BY 1")
def bs9(spark, d):
    m = B.resampled_means(score_cells(spark, d, ROLES), "g", ["role", "n_units"], N_BOOT, list(SEEDS))
    i = B.lead(m, "role", "model", "tree", ["seed", "n_units"]).withColumn("v", B.reading(F.col("ci_low"), F.col("ci_high")))
    per = i.groupBy("n_units").agg(F.count("*").alias("n_seeds"), F.count_distinct("v").alias("n_readings"), F.min_by("v", "seed").alias("first"), F.collect_list("v").alias("vs"))
    return per.select("n_units", "n_seeds", "n_readings", F.size(F.filter("vs", lambda v: v != F.col("first"))).cast("long").alias("n_disagree"))


@query("bs10_family_curves", f"WITH {scores_sql()}, m AS (SELECT fam, n_units, avg(correct::DOUBLE) AS mean FROM scores GROUP BY 1, 2) SELECT fam, round(regr_slope(mean, log10(n_units)), 6) AS slope, round(regr_intercept(mean, log10(n_units)), 6) AS intercept, round(regr_r2(mean, log10(n_units)), 6) AS r2 FROM m GROUP BY 1")
def bs10(spark, d):
    m = scores(spark, d).groupBy("fam", "n_units").agg(F.avg(F.col("correct").cast("double")).alias("mean")).withColumn("x", F.log10("n_units"))
    return rounded(m.groupBy("fam").agg(*B.fit_line("x", "mean")))


@query("bs11_operating_characteristics")
def bs11(spark, d):
    m = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sd"))
    return B.verdict_probabilities(m, "mean", "sd", [49.0, 50.0, 51.0], ["p_low", "p_below", "p_above", "p_high"])


@query("bs12_loglog_interpolation", f"""WITH c(n, cost) AS (VALUES (1000.0, 14.5), (10000.0, 40.3), (100000.0, 203.6), (800000.0, 1324.6)), q AS (SELECT o_orderkey, o_totalprice AS ask FROM orders),
l AS (SELECT o_orderkey, ask, (SELECT max(n) FROM c WHERE n <= ask) AS a, (SELECT min(n) FROM c WHERE n >= ask) AS b FROM q)
SELECT o_orderkey, round(CASE WHEN a = b THEN (SELECT cost FROM c WHERE n = a) ELSE pow(10, log10(x.cost) + (log10(y.cost) - log10(x.cost)) * (log10(ask) - log10(a)) / (log10(b) - log10(a))) END, 4) AS value FROM l LEFT JOIN c x ON x.n = a LEFT JOIN c y ON y.n = b""")
def bs12(spark, d):
    curve = spark.createDataFrame([(1000.0, 14.5), (10000.0, 40.3), (100000.0, 203.6), (800000.0, 1324.6)], "n double, cost double")
    return B.interpolated(curve, "n", "cost", read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("value", 4).alias("value"))


@query("bs13_selective_accuracy", "SELECT count(*) AS n, round(avg((event_type = 'click')::INT), 6) AS accuracy FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= greatest(1, floor(n * 10 / 100))")
def bs13(spark, d):
    e = read(spark, d, "events").withColumn("hit", (F.col("event_type") == "click").cast("int"))
    return rounded(B.selective(e, "value", "event_id", "hit", 10))


@query("bs14_top_k", f"WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) AS r FROM predictions) SELECT round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 2)::INT), 6) AS top2, round(avg((r <= 3)::INT), 6) AS top3 FROM r WHERE class = y")
def bs14(spark, d):
    return rounded(B.top_k_hits(predictions(spark, d), "row_id", "class", "p", "y", [1, 2, 3]))
