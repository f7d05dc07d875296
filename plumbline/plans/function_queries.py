"""PRJ1 to PRJ10 and SC1 to SC33."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import bytefeatures as BF
from plumbline.functions import geodesy as G
from plumbline.functions import textnum as T
from plumbline.functions import traces as TR
from plumbline.functions.portable import draw, key_hash, sql_hash
from plumbline.plans.inputs import CORPUS, corpus, read, scores, scores_sql
from plumbline.plans.registry import query


def binary_docs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


@query("prj1_feature_families", f"WITH {CORPUS} SELECT row_id, list_concat(features[1:8], features[33:48]) AS f FROM corpus")
def prj1(spark, d):
    c = corpus(spark, d)
    return c.select("row_id", F.concat(F.slice("features", 1, 8), F.slice("features", 33, 16)).alias("f"))


@query("prj2_first_columns", f"WITH {CORPUS} SELECT row_id, features[1:10] AS f FROM corpus")
def prj2(spark, d):
    return corpus(spark, d).select("row_id", F.slice("features", 1, 10).alias("f"))


@query("prj3_standardise", f"WITH {CORPUS}, s AS (SELECT avg(features[1]::DOUBLE) AS m, coalesce(nullif(stddev_pop(features[1]::DOUBLE), 0), 1) AS sd FROM corpus WHERE fam <> 'f0') SELECT row_id, round((features[1]::DOUBLE - m) / sd, 6) AS z FROM corpus, s")
def prj3(spark, d):
    from plumbline.operators.models import standardised

    c = corpus(spark, d).withColumn("x", F.col("features")[0].cast("double"))
    return standardised(c, ["x"], F.col("fam") != "f0").select("row_id", F.round("x", 6).alias("z"))


@query("prj4_family_filter", f"WITH {CORPUS} SELECT row_id, fam FROM corpus WHERE fam <> 'f3' AND y IN (0, 2, 4)")
def prj4(spark, d):
    return corpus(spark, d).where((F.col("fam") != "f3") & F.col("y").isin(0, 2, 4)).select("row_id", "fam")


@query("prj5_min_class_count", "SELECT p_partkey, p_type FROM (SELECT *, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE n >= 20")
def prj5(spark, d):
    from plumbline.operators.models import min_class

    return min_class(read(spark, d, "part"), "p_type", 20).select("p_partkey", "p_type")


@query("prj6_residue", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def prj6(spark, d):
    return read(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(10)) == 3).select("o_orderkey")


@query("prj7_bands", "SELECT p_partkey, CASE WHEN r >= 0 AND r < 1200 THEN 0 WHEN r >= 1200 AND r < 1500 THEN 1 WHEN r >= 1500 AND r < 1800 THEN 2 WHEN r >= 1800 AND r < 2100 THEN 3 ELSE 4 END AS band FROM (SELECT p_partkey, p_retailprice AS r FROM part)")
def prj7(spark, d):
    return read(spark, d, "part").select("p_partkey", TR.band(F.col("p_retailprice")).alias("band"))


@query("prj8_typed_numeric", """SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS numeric FROM events""")
def prj8(spark, d):
    v = F.variant_get(F.parse_json("props"), "$.k", "variant")
    kind = F.schema_of_variant(v)
    return read(spark, d, "events").select("event_id", F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)).alias("numeric"))


@query("prj9_threshold_label", "SELECT event_id, value > (SELECT quantile_cont(value, 0.75) FROM events WHERE event_type <> 'click') AS label FROM events")
def prj9(spark, d):
    e = read(spark, d, "events")
    cut = e.where("event_type <> 'click'").agg(F.percentile("value", 0.75).alias("cut"))
    return e.crossJoin(F.broadcast(cut)).select("event_id", (F.col("value") > F.col("cut")).alias("label"))  # one row


@query("prj10_clip_and_guard", "SELECT o_orderkey, least(greatest(o_totalprice, 1000), 200000) AS clipped, CASE WHEN o_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / (o_custkey % 7) END AS guarded FROM orders")
def prj10(spark, d):
    ratio = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / (F.col("o_custkey") % 7)).otherwise(F.lit(float("nan")))
    return read(spark, d, "orders").select("o_orderkey", F.least(F.greatest("o_totalprice", F.lit(1000.0)), F.lit(200000.0)).alias("clipped"), F.nanvl(ratio, F.lit(0.0)).alias("guarded"))


HEX = "h AS (SELECT doc_id, hex(encode(text)) AS t, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)"
BYTES = f"WITH {HEX}, b AS (SELECT doc_id, n, i, CAST('0x' || x AS INTEGER) AS v FROM (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(regexp_extract_all(t, '..')) AS x FROM h))"


@query("sc1_carve", f"WITH {HEX} SELECT doc_id, CASE WHEN n >= 320 AND (n - 256) // 2 >= 8 THEN substr(t, CAST(2 * ((n - 256) // 2) + 1 AS BIGINT), 512) END AS window FROM h")
def sc1(spark, d):
    return binary_docs(spark, d).select("doc_id", F.hex(BF.carve(F.col("data"), 256)).alias("window"))


@query("sc2_compress")
def sc2(spark, d):
    docs = binary_docs(spark, d).withColumn("level", (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    return BF.compressed(docs, "data", "level").select("doc_id", "level", F.length("stream").alias("n"), F.sha2("stream", 256).alias("sha256"))


def byte_array_docs(spark, d):
    return binary_docs(spark, d).select("doc_id", BF.byte_values(F.col("data")).alias("v"))


@query("sc3_byte_histogram", f"{BYTES} SELECT doc_id, v AS value, count(*) AS n FROM b GROUP BY 1, 2")
def sc3(spark, d):
    return BF.histogram_rows(byte_array_docs(spark, d), "doc_id", "v")


@query("sc4_pair_histogram", f"{BYTES}, p AS (SELECT doc_id, (v * 31 + lead(v) OVER (PARTITION BY doc_id ORDER BY i)) % 256 AS value FROM b) SELECT doc_id, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2")
def sc4(spark, d):
    v = byte_array_docs(spark, d)
    pairs = F.zip_with(F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda a, b: (a * 31 + b) % 256)
    return BF.histogram_rows(v.select("doc_id", pairs.alias("p")), "doc_id", "p")


@query("sc5_ones_ratio", f"{BYTES} SELECT doc_id, round(sum(bit_count(v)) / (8.0 * max(n)), 9) AS ones FROM b GROUP BY 1")
def sc5(spark, d):
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x))
    return byte_array_docs(spark, d).where(F.size("v") > 0).select("doc_id", F.round(total / (F.lit(8.0) * F.size("v")), 9).alias("ones"))


@query("sc6_bit_runs")
def sc6(spark, d):
    f = BF.with_features(binary_docs(spark, d), "data", "doc_id")
    return f.select("doc_id", F.explode(BF.family("features", ["bit_runs"])).alias("share"))


@query("sc7_window_entropy", f"""{BYTES}, w AS (SELECT doc_id, i // 64 AS w, v, count(*) AS c FROM b WHERE i < n // 64 * 64 AND n >= 128 GROUP BY 1, 2, 3), e AS (SELECT doc_id, w, -sum(c / 64.0 * log2(c / 64.0)) AS e FROM w GROUP BY 1, 2)
SELECT doc_id, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS sd, round(min(e), 6) AS low, round(max(e), 6) AS high, round(quantile_cont(e, 0.25), 6) AS p25, round(quantile_cont(e, 0.75), 6) AS p75 FROM e GROUP BY 1""")
def sc7(spark, d):
    v = byte_array_docs(spark, d).where(F.size("v") >= 128)
    windows = F.transform(F.sequence(F.lit(0), (F.size("v") / 64).cast("int") - 1), lambda w: BF.entropy_of(F.slice("v", w * 64 + 1, 64)))
    e = v.select("doc_id", F.explode(windows).alias("e")).groupBy("doc_id")
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.agg(r(F.avg("e"), "mean"), r(F.stddev_pop("e"), "sd"), r(F.min("e"), "low"), r(F.max("e"), "high"), r(F.percentile("e", 0.25), "p25"), r(F.percentile("e", 0.75), "p75"))


@query("sc8_byte_entropy", f"{BYTES}, c AS (SELECT doc_id, v, count(*) AS c, max(n) AS n FROM b GROUP BY 1, 2) SELECT doc_id, round(-sum(c / n::DOUBLE * log2(c / n::DOUBLE)), 6) AS entropy, count(*) / 256.0::DOUBLE AS distinct_share FROM c GROUP BY 1")
def sc8(spark, d):
    v = byte_array_docs(spark, d).where(F.size("v") > 0)
    return v.select("doc_id", F.round(BF.entropy_of(F.col("v")), 6).alias("entropy"), (F.size(F.array_distinct("v")) / 256.0).alias("distinct_share"))


@query("sc9_alignment_stats")
def sc9(spark, d):
    return BF.with_features(binary_docs(spark, d), "data", "doc_id").select("doc_id", BF.family("features", ["align_stats"]).alias("stats"))


@query("sc10_alignment_histograms")
def sc10(spark, d):
    return BF.with_features(binary_docs(spark, d), "data", "doc_id").select("doc_id", BF.family("features", ["align_hist"]).alias("hist"))


@query("sc11_complement_words", f"{BYTES}, w AS (SELECT doc_id, v + 256 * lead(v) OVER o AS lo, lead(v, 2) OVER o + 256 * lead(v, 3) OVER o AS hi FROM b WHERE n >= 8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(*) FILTER (xor(lo, hi) = 65535) AS n_complement FROM w GROUP BY 1 UNION ALL SELECT doc_id, 0 FROM h WHERE n < 8")
def sc11(spark, d):
    return byte_array_docs(spark, d).select("doc_id", BF.complement_words(F.col("v")).cast("long").alias("n_complement"))


@query("sc12_feature_vector")
def sc12(spark, d):
    return BF.with_features(binary_docs(spark, d), "data", "doc_id")


@query("sc13_generated_content")
def sc13(spark, d):
    return BF.generated(spark, 70, 4096, 11).select("chunk_id", "fam", F.sha2("data", 256).alias("sha256"))


@query("sc14_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def sc14(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))


@query("sc15_canonical_json", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS doc FROM events""")
def sc15(spark, d):
    return read(spark, d, "events").select("event_id", T.canonical_json("props").alias("doc"))


def json_docs(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus").alias("o"))
    return o.groupBy("o_custkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list("o")).alias("orders"))).alias("doc"))


@query("sc16_json_path", """SELECT o_custkey, CAST(count(*) AS VARCHAR) AS n, CAST(max(o_orderkey) AS VARCHAR) AS last, arg_min(o_orderstatus, o_orderkey) AS first_status, CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS n_f, CAST(NULL AS VARCHAR) AS absent FROM orders GROUP BY 1""")
def sc16(spark, d):
    j = json_docs(spark, d).withColumns({"p1": F.lit("orders|len"), "p2": F.lit("orders.-1.o_orderkey"), "p3": F.lit("orders.0.o_orderstatus"), "p4": F.lit("orders|count:o_orderstatus=F"), "p5": F.lit("orders.0.none")})
    return j.select("o_custkey", *[T.json_path("doc", p).alias(n) for p, n in (("p1", "n"), ("p2", "last"), ("p3", "first_status"), ("p4", "n_f"), ("p5", "absent"))])


@query("sc17_fixed_json_path", "SELECT o_custkey, min(o_orderkey) AS first, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def sc17(spark, d):
    return json_docs(spark, d).select("o_custkey", T.fixed_path(F.col("doc"), "$.orders[0].o_orderkey", "long").alias("first"), T.fixed_path(F.col("doc"), "$.orders[0].o_orderstatus").alias("status"))


@query("sc18_numeric_leaves", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders GROUP BY 1")
def sc18(spark, d):
    return T.numeric_leaves(json_docs(spark, d), ["o_custkey"], "doc").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("sc19_number_tokens")
def sc19(spark, d):
    return T.number_tokens(read(spark, d, "documents"), ["doc_id"], "text").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("sc20_scrub", r"SELECT page_id, trim(regexp_replace(regexp_replace('at ' || url || ' seen', '(?:https?://|www\.)\S+', ' ', 'g'), '\b[0-9a-fA-F]{16,}\b', ' ', 'g')) AS line FROM pages")
def sc20(spark, d):
    return read(spark, d, "pages").select("page_id", F.trim(T.scrub(F.concat(F.lit("at "), "url", F.lit(" seen")))).alias("line"))


@query("sc21_allow_list", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS token FROM part WHERE p_size NOT IN (7, 9)")
def sc21(spark, d):
    allow = spark.createDataFrame([("7", "seven"), ("9", "nine"), ("11", " ")], "value string, reason string")
    return T.allowed(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("token")), allow).select("p_partkey", "token")


@query("sc22_freshness", "SELECT c_custkey, regexp_extract(t, 'spent ([0-9]+)', 1) AS found, coalesce(nullif(regexp_extract(t, 'spent ([0-9]+)', 1), '') = CAST(n AS VARCHAR), false) AS fresh FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'reworded' ELSE 'spent ' || CAST(c_custkey % 5 AS VARCHAR) END AS t, c_custkey % 4 AS n FROM customer) WHERE regexp_matches(t, 'spent') UNION ALL SELECT c_custkey, NULL, false FROM customer WHERE c_custkey % 9 = 0")
def sc22(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.when(k % 9 == 0, "reworded").otherwise(F.concat(F.lit("spent "), (k % 5).cast("string"))).alias("t"), F.lit("spent ([0-9]+)").alias("p"), (k % 4).cast("string").alias("now"))
    return T.fresh(c, "t", "p", "now").select("c_custkey", "found", "fresh")


@query("sc23_version_floor", "SELECT p_partkey, [CAST(p_size AS INTEGER), CAST(p_partkey % 7 AS INTEGER)] AS v, [CAST(p_size AS INTEGER), CAST(p_partkey % 7 AS INTEGER)] >= [25, 3] AS ok FROM part")
def sc23(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("-beta.4")).alias("text"))
    return p.select("p_partkey", T.version_array(F.col("text")).alias("v"), T.at_least(F.col("text"), [25, 3]).alias("ok"))


@query("sc24_software_name", r"SELECT p_partkey, lower(trim(regexp_replace(p_type, '[^A-Za-z0-9+\-]+', ' ', 'g'))) AS name FROM part")
def sc24(spark, d):
    return read(spark, d, "part").select("p_partkey", T.software_name(F.concat("p_type", F.lit(" v. 3.2"))).alias("name"))


@query("sc25_gps_time", "SELECT event_id, CAST(floor(date_diff('day', DATE '1980-01-06', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, CAST((date_diff('day', DATE '1980-01-06', CAST(ts AS DATE)) % 7) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS sow FROM events")
def sc25(spark, d):
    return read(spark, d, "events").select("event_id", G.gps_week(F.col("ts")).alias("week"), G.seconds_of_week(F.col("ts")).alias("sow"))


NAV = ("sqrt_a", "e", "m0", "delta_n", "omega", "omega0", "omega_dot", "i0", "idot", "cus", "cuc", "crs", "crc", "cis", "cic", "toe", "af0", "af1", "af2", "tgd")


def navigation(spark, d):
    """Records near a nominal orbit, moved a little by hashes of the event."""
    x = lambda name, span: (draw(1000, F.lit(name), "event_id") / 1000.0 - 0.5) * span
    base = {"sqrt_a": (5153.6, 0.4), "e": (0.01, 0.01), "m0": (0.0, 6.0), "delta_n": (4.5e-9, 1e-10), "omega": (0.5, 1.0), "omega0": (1.0, 2.0), "omega_dot": (-8e-9, 1e-10), "i0": (0.96, 0.02), "idot": (1e-10, 1e-11), "cus": (5e-6, 1e-6), "cuc": (2e-6, 1e-6), "crs": (40.0, 20.0), "crc": (250.0, 50.0), "cis": (5e-8, 1e-8), "cic": (5e-8, 1e-8), "af0": (1e-4, 1e-5), "af1": (1e-12, 1e-12), "af2": (0.0, 0.0), "tgd": (5e-9, 1e-9)}
    e = read(spark, d, "events").select("event_id", G.seconds_of_week(F.col("ts")).alias("t"))
    return e.select("*", *[(F.lit(a) + x(n, b)).alias(n) for n, (a, b) in base.items()], (F.floor(F.col("t") / 7200) * 7200).cast("double").alias("toe"))


@query("sc26_orbit_propagation")
def sc26(spark, d):
    return G.propagate(navigation(spark, d), "t", "toe").select("event_id", *[F.round(c, 3).alias(c) for c in ("sat_x", "sat_y", "sat_z")], F.round(F.col("sat_clk") * 1e9, 4).alias("clk_ns"))


@query("sc27_orbit_errors", """WITH p AS (SELECT o_orderkey, o_totalprice + 2e7 AS x, o_custkey + 1e7 AS y, o_orderkey + 5e6 AS z, o_custkey % 7 - 3 AS dx, o_custkey % 5 - 2 AS dy, o_custkey % 3 - 1 AS dz FROM orders),
n AS (SELECT *, sqrt(x*x+y*y+z*z) AS rn, y*3000-z*2000 AS nx, z*(-1000)-x*3000 AS ny, x*2000-y*(-1000) AS nz FROM p), s AS (SELECT *, ny*z-nz*y AS sx, nz*x-nx*z AS sy, nx*y-ny*x AS sz FROM n),
e AS (SELECT o_orderkey, (dx*x+dy*y+dz*z)/rn AS radial, (dx*sx+dy*sy+dz*sz)/sqrt(sx*sx+sy*sy+sz*sz) AS along, (dx*nx+dy*ny+dz*nz)/sqrt(nx*nx+ny*ny+nz*nz) AS "cross" FROM s)
SELECT o_orderkey, round(radial, 5) AS radial, round(along, 5) AS along, round("cross", 5) AS "cross", round(sqrt(pow(0.98 * radial - 0.5, 2) + (along * along + "cross" * "cross") / 49), 5) AS sisre FROM e""")
def sc27(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_custkey")
    p = o.select("o_orderkey", (F.col("o_totalprice") + 2e7).alias("x"), (k + 1e7).alias("y"), (F.col("o_orderkey") + 5e6).alias("z"), F.lit(-1000.0).alias("vx"), F.lit(2000.0).alias("vy"), F.lit(3000.0).alias("vz"), k)
    p = p.select("*", (F.col("x") + k % 7 - 3).alias("bx"), (F.col("y") + k % 5 - 2).alias("by"), (F.col("z") + k % 3 - 1).alias("bz"))
    e = G.orbit_errors(p, ["bx", "by", "bz"], ["x", "y", "z"], ["vx", "vy", "vz"])
    e = e.withColumn("sisre", G.sisre(F.col("radial"), F.col("along"), F.col("cross"), F.lit(0.5)))
    return e.select("o_orderkey", *[F.round(c, 5).alias(c) for c in ("radial", "along", "cross", "sisre")])


def clocks(spark, d):
    """A falling clock for each user with enough events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = read(spark, d, "events").withColumn("left", F.lit(100000.0) - F.sum("value").over(w))
    return e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "left"))), lambda x: x["left"]).alias("secs"))


@query("sc28_clock_features", """WITH c AS (SELECT user_id, ts, event_id, 100000 - sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events),
u AS (SELECT user_id, CASE WHEN lag(s) OVER w IS NOT NULL THEN least(greatest(lag(s) OVER w + 2 - s, 0), 100000 + 2 * (n - 1)) END AS u FROM c WHERE n >= 8 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(count(u) AS DOUBLE) AS n, round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS sd, round(quantile_cont(u, 0.5), 6) AS median, round(quantile_cont(u, 0.9), 6) AS p90, round(sum(u), 4) AS total FROM u GROUP BY 1""")
def sc28(spark, d):
    c = clocks(spark, d).withColumns({"base": F.lit(100000), "inc": F.lit(2)})
    f = c.select("user_id", TR.clock_features("secs", "base", "inc").alias("f")).where("f is not null")
    places = {"n": 6, "mean": 6, "sd": 6, "median": 6, "p90": 6, "total": 4}
    return f.select("user_id", *[F.round(F.col("f")[TR.CLOCK_FEATURES.index(n)], p).alias(n) for n, p in places.items()])


@query("sc29_sat_features")
def sc29(spark, d):
    lit = lambda j: (draw(40, "o_orderkey", j) + 1) * F.when(draw(2, F.lit("s"), "o_orderkey", j) == 0, 1).otherwise(-1)
    o = read(spark, d, "orders").withColumn("clause", F.array(*[lit(j).cast("int") for j in range(3)]))
    s = o.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "clause"))), lambda x: x["clause"]).alias("clauses"))
    s = s.withColumn("sign", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.when(F.pmod(F.xxhash64("o_custkey", i), F.lit(2)) == 0, 1).otherwise(-1)))
    return s.select("o_custkey", F.transform(TR.sat_features("clauses", "sign"), lambda x: F.round(x, 6)).alias("f"))


@query("sc30_clock_regex", "SELECT event_id, [CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)] AS secs, CAST(user_id AS INTEGER) AS base, 2 AS inc FROM events")
def sc30(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("e4 [%clk "), F.date_format("ts", "H:mm:ss"), F.lit("] e5")).alias("t"), F.concat(F.col("user_id").cast("string"), F.lit("+2")).alias("tc"))
    base, inc = T.time_control(F.col("tc"))
    return e.select("event_id", T.clock_seconds(F.col("t")).alias("secs"), base.alias("base"), inc.alias("inc"))


@query("sc31_cyclic_neighbours", "SELECT n_nationkey, (n_nationkey + 3) % 25 AS successor, (n_nationkey + 25 - 3) % 25 AS predecessor FROM nation")
def sc31(spark, d):
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select("n_nationkey", F.pmod(k + 3, F.lit(25)).alias("successor"), F.pmod(k - 3, F.lit(25)).alias("predecessor"))


@query("sc32_bit_string", f"WITH {scores_sql()} SELECT g, n_units, string_agg(CAST(correct AS VARCHAR), '' ORDER BY row_id) AS bits FROM scores GROUP BY 1, 2")
def sc32(spark, d):
    s = scores(spark, d).groupBy("g", "n_units").agg(F.sort_array(F.collect_list(F.struct("row_id", "correct"))).alias("r"))
    return s.select("g", "n_units", F.array_join(F.transform("r", lambda x: x["correct"].cast("string")), "").alias("bits"))


@query("sc33_scalar_math", "SELECT o_orderkey, round(log2(o_totalprice), 6) AS l2, round(log10(o_totalprice), 6) AS l10, round(atan2(o_custkey, o_orderkey), 6) AS a, round(sin(o_custkey), 6) AS s, round(cos(o_custkey), 6) AS c, round(pow(o_totalprice, 0.25), 6) AS p FROM orders")
def sc33(spark, d):
    r = lambda c, n: F.round(c, 6).alias(n)
    return read(spark, d, "orders").select("o_orderkey", r(F.log2("o_totalprice"), "l2"), r(F.log10("o_totalprice"), "l10"), r(F.atan2("o_custkey", "o_orderkey"), "a"), r(F.sin("o_custkey"), "s"), r(F.cos("o_custkey"), "c"), r(F.pow("o_totalprice", F.lit(0.25)), "p"))


@query("portable_draws", f"SELECT o_orderkey, {sql_hash('5', 'o_orderkey')} AS h FROM orders")
def portable(spark, d):
    return read(spark, d, "orders").select("o_orderkey", key_hash(5, "o_orderkey").alias("h"))
