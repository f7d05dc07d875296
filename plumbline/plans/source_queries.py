"""SRC1 to SRC12, SNK1 to SNK4, and streams. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.inputs import read
from plumbline.plans.registry import query
from plumbline.sources import files, sinks
from plumbline.sources.shared import fresh_path
from plumbline.streaming import ledger as stream


@query("src1_column_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 49")
def src1(spark, d):
    return read(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_extendedprice")


@query("src2_gather", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def src2(spark, d):
    wanted = read(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.gather(read(spark, d, "orders"), wanted, "o_orderkey", ["o_totalprice"])


def nation_files(spark, d, label):
    """A JSON file for each region, below one folder a region."""
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))).alias("value"))
    path = fresh_path(spark, label)
    n.repartition(5, "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return path


@query("src3_json_documents", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, arg_min(n_name, n_nationkey) AS first FROM nation GROUP BY 1")
def src3(spark, d):
    docs = files.json_documents(spark, nation_files(spark, d, "json"), "*.txt")
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int")
    return docs.select(region.alias("n_regionkey"), F.size(F.variant_get("doc", "$.nations", "array<variant>")).alias("n"), F.variant_get("doc", "$.nations[0].n_name", "string").alias("first"))


def event_lines(spark, d, label):
    path = fresh_path(spark, label)
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "completed").otherwise("started")
    good = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), kind.alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")))
    e.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(good).alias("value")).write.text(path)
    return path


LINES = "l AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS name, CASE WHEN event_id % 50 = 0 THEN 'unparseable' WHEN event_type = 'purchase' THEN 'completed' ELSE 'started' END AS event FROM events)"


@query("src4_tolerant_json_lines", f"WITH {LINES} SELECT event, count(*) AS n FROM l GROUP BY 1")
def src4(spark, d):
    return files.json_lines(spark, event_lines(spark, d, "jsonl"), "name string, event string, t long").groupBy("event").agg(F.count("*").alias("n"))


@query("src5_numeric_cells", "SELECT CAST(sum(s_suppkey) + sum(s_nationkey) AS DOUBLE) AS total, 2 * count(*) AS n FROM supplier")
def src5(spark, d):
    path = fresh_path(spark, "csv")
    read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return files.numeric_cells(spark, path).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("src6_banked_numbers", "SELECT CAST(sum(n_nationkey) AS DOUBLE) + (SELECT CAST(sum(r_regionkey) AS DOUBLE) FROM region) AS total, count(*) + (SELECT count(*) FROM region) AS n FROM nation")
def src6(spark, d):
    path = fresh_path(spark, "banked")
    n = read(spark, d, "nation").agg(F.to_json(F.collect_list("n_nationkey")).alias("value"))
    n.write.text(f"{path}/a")
    read(spark, d, "region").select("r_regionkey", "r_name").write.csv(f"{path}/b")
    return files.banked_numbers(spark, path).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def archived(spark, d, kind):
    """One archive of a CSV member for each region, made on the driver from 25 rows."""
    import io
    import tarfile
    import zipfile

    rows = read(spark, d, "nation").orderBy("n_nationkey").collect()
    parts = {f"r{k}.csv": "key,name\n" + "".join(f"{r['n_nationkey']},{r['n_name']}\n" for r in rows if r["n_regionkey"] == k) for k in sorted({r["n_regionkey"] for r in rows})}
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, text in parts.items():
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
    return put_binary(spark, f"{fresh_path(spark, kind)}/all.{kind}", out.getvalue())


def put_binary(spark, path, content):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
    return path.rsplit("/", 1)[0]


@query("src7_zip_members", "SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.csv' AS member, n_nationkey AS key, n_name AS name FROM nation")
def src7(spark, d):
    return files.member_csv(files.archive_members(spark, archived(spark, d, "zip"), r"\.csv$"), "key int, name string")


@query("src8_tar_members", r"SELECT sha256(string_agg(t, '' ORDER BY n_regionkey)) AS sha256 FROM (SELECT n_regionkey, 'key,name' || chr(10) || string_agg(CAST(n_nationkey AS VARCHAR) || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation GROUP BY 1)")
def src8(spark, d):
    return files.blob(files.archive_members(spark, archived(spark, d, "tgz")), ["path"]).select("sha256")


@query("src9_allowed_files", "SELECT r_name AS name, CASE WHEN r_regionkey < 2 THEN 'missing' ELSE 'not listed' END AS problem FROM region WHERE r_regionkey < 2 OR r_regionkey > 3")
def src9(spark, d):
    r = read(spark, d, "region").withColumnRenamed("r_name", "name")
    return files.check_listing(r.where("r_regionkey >= 2"), r.where("r_regionkey <= 3"), "name")


@query("src10_truncated_stream")
def src10(spark, d):
    import hashlib

    import zstandard

    names = [r["n_name"] for r in read(spark, d, "nation").orderBy("n_nationkey").collect()]
    raw = zstandard.ZstdCompressor().compress("".join(f"{hashlib.sha256(f'{n}{i}'.encode()).hexdigest()}\n" for i in range(400) for n in names).encode())
    return files.truncated_lines(spark, put_binary(spark, f"{fresh_path(spark, 'zst')}/cut.zst", raw[: len(raw) * 3 // 4])).select("line_no", "line")


@query("src11_navigation_products", "SELECT CAST(user_id % 32 + 1 AS INTEGER) AS prn, CAST((date_diff('day', DATE '1980-01-06', CAST(ts AS DATE)) % 7) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS sow, round(value, 6) AS bias FROM events")
def src11(spark, d):
    path = fresh_path(spark, "clk")
    e = read(spark, d, "events")
    e.select(F.format_string("AS G%02d  %s  2   %.6f", F.col("user_id") % 32 + 1, F.date_format("ts", "yyyy MM dd HH mm ss.SSSSSS"), F.col("value")).alias("value")).write.text(path)
    return files.precise_clocks(spark, path).select("prn", "sow", F.round("bias", 6).alias("bias"))


@query("src12_pinned_sources", "SELECT 'r' || CAST(r_regionkey AS VARCHAR) || '.txt' AS name, CASE r_regionkey WHEN 1 THEN 'content differs' WHEN 2 THEN 'not pinned' END AS problem FROM region WHERE r_regionkey IN (1, 2) UNION ALL SELECT 'r9.txt', 'missing'")
def src12(spark, d):
    path = fresh_path(spark, "pins")
    rows = read(spark, d, "region").orderBy("r_regionkey").collect()
    for r in rows:
        sinks.put_text(spark, f"{path}/r{r['r_regionkey']}.txt", r["r_name"])
    k = F.col("r_regionkey")
    pins = read(spark, d, "region").where("r_regionkey <> 2").select(F.concat(F.lit("r"), k.cast("string"), F.lit(".txt")).alias("name"), F.sha2(F.when(k == 1, "other").otherwise(F.col("r_name")), 256).alias("sha256"))
    missing = spark.createDataFrame([("r9.txt", "x")], "name string, sha256 string")
    return files.verify_pins(spark, path, pins.unionAll(missing))


@query("snk1_result_json", """SELECT '{"largest":' || CAST(max(n_nationkey) AS VARCHAR) || ',"n":' || CAST(count(*) AS VARCHAR) || '}' AS doc FROM nation""")
def snk1(spark, d):
    one = read(spark, d, "nation").agg(F.count("*").alias("n"), F.max("n_nationkey").alias("largest"))
    path = sinks.result_json(one, f"{fresh_path(spark, 'result')}/result.json")
    return spark.read.text(path).select(F.col("value").alias("doc"))


@query("snk2_append_lines", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation")
def snk2(spark, d):
    n, path = read(spark, d, "nation").select("n_nationkey"), fresh_path(spark, "append")
    for part in (n.where("n_nationkey < 10"), n.where("n_nationkey >= 10")):
        sinks.append_lines(part, path)
    return spark.read.schema("n_nationkey long").json(path).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))


@query("snk3_column_files", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def snk3(spark, d):
    path = sinks.columns(read(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), fresh_path(spark, "columns"), ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("snk4_rendered_table", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '| --- | --- |'")
def snk4(spark, d):
    text = sinks.markdown_table(read(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), 10)
    return spark.createDataFrame([(x,) for x in text.strip().split("\n")], "line string")


@query("str1_stream_attempts", f"WITH {LINES} SELECT name, count(*) FILTER (event = 'started') AS n_started, count(*) FILTER (event = 'completed') AS n_completed FROM l WHERE event <> 'unparseable' GROUP BY 1")
def str1(spark, d):
    rows = stream.ledger_stream(spark, event_lines(spark, d, "stream"), "name string, event string, t long").where("event <> 'unparseable'")
    path = fresh_path(spark, "sunk")
    stream.append_sink(rows, path, fresh_path(spark, "offsets")).awaitTermination()
    from plumbline.operators.windows import attempts

    return attempts(spark.read.parquet(path), ["name"], "event").select("name", "n_started", "n_completed")
