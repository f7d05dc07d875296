"""SP1 to SP14: splits, samples, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.portable import sql_hash
from plumbline.operators import splits as S
from plumbline.plans.inputs import CORPUS, corpus, read
from plumbline.plans.registry import query

FAMS = [f"f{i}" for i in range(5)]
SEED = 7


def order_sql(key: str, source: str, extra: str = "", seed: int = SEED) -> str:
    part = f"PARTITION BY {extra} " if extra else ""
    cols = f"{extra}, {key}" if extra else key
    return f"ranked AS (SELECT {cols}, row_number() OVER ({part}ORDER BY {sql_hash(str(seed), key)}, {key}) AS r, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {cols} FROM {source}))"


@query("sp1_grouped_split", f"""WITH {CORPUS}, {order_sql('g', 'corpus')}
SELECT row_id, g, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'eval' ELSE 'train' END AS part FROM corpus JOIN ranked USING (g)""")
def sp1(spark, d):
    return S.grouped_split(corpus(spark, d), "g", 0.2, SEED).select("row_id", "g", "part")


@query("sp2_random_split", f"""WITH {order_sql('c_custkey', 'customer')}
SELECT c_custkey, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'eval' ELSE 'train' END AS part FROM ranked""")
def sp2(spark, d):
    return S.random_split(read(spark, d, "customer"), "c_custkey", 0.2, SEED).select("c_custkey", "part")


@query("sp3_temporal_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) * 100 <= count(*) OVER () * 80 THEN 'train' ELSE 'eval' END AS part FROM orders""")
def sp3(spark, d):
    return S.temporal_split(read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 80).select("o_orderkey", "part")


@query("sp4_rung_prefixes", f"""WITH {CORPUS}
SELECT rung, rung_part, count(*) AS n, sum(row_id) AS ids FROM (
  SELECT rung, row_id, CASE WHEN pool_pos >= floor(rung * 0.9) THEN 'validation' ELSE 'fit' END AS rung_part FROM corpus, (VALUES (100), (1000), (5000)) r(rung) WHERE pool_pos < rung) GROUP BY 1, 2""")
def sp4(spark, d):
    m = S.rung_members(corpus(spark, d), "pool_pos", [100, 1000, 5000])
    return m.groupBy("rung", "rung_part").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("sp5_group_validation", f"""WITH {CORPUS}, {order_sql('g', 'corpus', seed=SEED + 1)}
SELECT CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS part, count(*) AS n_rows, count(DISTINCT g) AS n_groups FROM corpus JOIN ranked USING (g) GROUP BY 1""")
def sp5(spark, d):
    return S.grouped_split(corpus(spark, d), "g", 0.1, SEED + 1).groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("g").alias("n_groups"))


@query("sp6_leave_one_family_out", f"""WITH {CORPUS}, f AS (SELECT DISTINCT fam AS fold FROM corpus)
SELECT fold, CASE WHEN fam = fold THEN 'held' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT fam) AS n_families,
  sum(CASE WHEN fam <> fold THEN 0 ELSE 1 END) AS n_of_fold FROM corpus, f GROUP BY 1, 2""")
def sp6(spark, d):
    folds = S.leave_one_out(corpus(spark, d), "fam", FAMS)
    return folds.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_distinct("fam").alias("n_families"), F.sum((F.col("fam") == F.col("fold")).cast("int")).alias("n_of_fold"))


@query("sp7_family_blocks", f"""WITH {CORPUS}, first AS (SELECT fam, g, min(pool_pos) AS first FROM corpus GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY first, g) AS r FROM first)
SELECT 'f' || CAST(b AS VARCHAR) AS block, fam, g, first, r FROM ranked, range(0, 5) x(b), range(0, 2) y(j) WHERE fam = 'f' || CAST((b + j) % 5 AS VARCHAR) AND r <= 3""")
def sp7(spark, d):
    return S.family_blocks(corpus(spark, d), "fam", "g", "pool_pos", FAMS, 2, 6)


@query("sp8_stratified_rungs", f"""WITH {CORPUS}, {order_sql('g', 'corpus', 'fam')}
SELECT divisor, fam, g, r FROM ranked, (VALUES (8), (4), (2), (1)) v(divisor) WHERE r <= ceil(n / divisor)""")
def sp8(spark, d):
    return S.stratified_rungs(corpus(spark, d), "fam", "g", [8, 4, 2, 1], SEED)


@query("sp9_doublings", f"""WITH {CORPUS}, {order_sql('g', 'corpus', 'fam')}
SELECT step, fam, g, r FROM ranked, range(0, 3) s(step) WHERE r <= 2 * pow(2, step)""")
def sp9(spark, d):
    return S.doublings(corpus(spark, d), "fam", "g", SEED, 2, 3).select("step", "fam", "g", "r")


@query("sp10_nested_composition", f"""WITH {CORPUS}, {order_sql('g', 'corpus', 'fam')}
SELECT step, fam, count(*) AS n_groups, sum(count(*)) OVER (PARTITION BY step) AS n_step FROM ranked, range(0, 3) s(step) WHERE r <= 2 * pow(2, step) GROUP BY step, fam""")
def sp10(spark, d):
    return S.composition(S.doublings(corpus(spark, d), "fam", "g", SEED, 2, 3), "step", "fam")


@query("sp11_sample", f"""SELECT c_custkey, c_mktsegment FROM customer ORDER BY {sql_hash('7', 'c_custkey')}, c_custkey LIMIT 50""")
def sp11(spark, d):
    return S.sample(read(spark, d, "customer"), "c_custkey", 50, SEED).select("c_custkey", "c_mktsegment")


@query("sp12_label_shuffle", f"""WITH {CORPUS}, a AS (SELECT row_id, y, row_number() OVER (ORDER BY {sql_hash('7', 'row_id')}, row_id) AS r FROM corpus),
b AS (SELECT y AS shuffled, row_number() OVER (ORDER BY {sql_hash('8', 'row_id')}, row_id) AS r FROM corpus)
SELECT row_id, y, shuffled FROM a JOIN b USING (r)""")
def sp12(spark, d):
    return S.shuffled_labels(corpus(spark, d), "row_id", "y", SEED).select("row_id", "y", "shuffled")


@query("sp13_class_coverage", f"""WITH {CORPUS}, {order_sql('g', 'corpus')}
SELECT part, count(DISTINCT y) AS n_classes, count(DISTINCT y) = 10 AS covered FROM (
  SELECT y, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'eval' ELSE 'train' END AS part FROM corpus JOIN ranked USING (g)) GROUP BY part""")
def sp13(spark, d):
    return S.coverage(S.grouped_split(corpus(spark, d), "g", 0.2, SEED), "part", "y", 10)


@query("sp14_pool_shortage", f"""WITH {CORPUS} SELECT fam, count(*) AS n, greatest(0, 101 - count(*)) AS missing, count(*) >= 101 AS enough FROM corpus GROUP BY fam""")
def sp14(spark, d):
    return S.shortage(corpus(spark, d), "fam", 101)
