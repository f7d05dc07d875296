"""Scans of result files: JSON documents, JSON lines, CSV cells, archives, truncated streams,
fixed-width navigation products, pinned sources. All read through Spark's own file sources, so any
file system that Spark knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.geodesy import seconds_of_week
from plumbline.functions.textnum import NUMBER, numeric_leaves


def gather(df: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Some rows and some columns of a scan: the projection reaches the reader, rows semi-join."""
    return df.select(key, *columns).join(wanted.select(key), key, "left_semi")


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, text, doc (VARIANT, null where the text is not JSON): a row a file."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.try_parse_json("value").alias("doc"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; a line that does not parse is kept, with `event` unparseable and
    its text in `raw`."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("raw", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").json(path)
    event = F.when(F.col("raw").isNotNull(), "unparseable").otherwise(F.col("event")) if "event" in full.names else F.when(F.col("raw").isNotNull(), "unparseable")
    return rows.withColumn("event", event)


def numeric_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """path, value: every numeric cell of delimited files, header or not."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    cells = lines.select("path", F.explode(F.split("line", "\\t" if sep == "\t" else sep)).alias("cell"))
    return cells.select("path", F.trim(F.translate("cell", '"', "")).try_cast("double").alias("value")).where("value is not null and not isnan(value)")


def banked_numbers(spark: SparkSession, path: str) -> DataFrame:
    """path, value of every number below a folder: JSON by its leaves (or as text where it does not
    parse), delimited files by cells, anything else by a pattern."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    is_json = F.col("path").endswith(".json") & F.try_parse_json("text").isNotNull()
    from_json = numeric_leaves(raw.where(is_json), ["path"], "text")
    rest = raw.where(~is_json)
    cells = rest.where(F.col("path").rlike(r"\.[ct]sv$")).select("path", F.explode(F.split("text", r"[,\t\n]")).alias("c")).select("path", F.trim("c").try_cast("double").alias("value"))
    other = rest.where(~F.col("path").rlike(r"\.[ct]sv$")).select("path", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("c")).select("path", F.col("c").try_cast("double").alias("value"))
    return from_json.unionAll(cells).unionAll(other).where("value is not null")


def archive_members(spark: SparkSession, path: str, pattern: str = ".*", glob: str = "*") -> DataFrame:
    """path, member, content of zip and (compressed) tar files whose member names match."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import re
        import tarfile
        import zipfile

        wanted = re.compile(pattern)

        def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
            if raw[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    yield from ((n, z.read(n)) for n in sorted(z.namelist()) if not n.endswith("/") and wanted.search(n))
            else:
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    for m in sorted(t.getmembers(), key=lambda m: m.name):
                        if m.isfile() and wanted.search(m.name):
                            yield m.name, t.extractfile(m).read()

        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, content in members(raw):
                    yield pa.RecordBatch.from_pydict({"path": [p], "member": [name], "content": pa.array([content], pa.binary())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(work, "path string, member string, content binary")


def blob(members: DataFrame, by: list[str]) -> DataFrame:
    """The sorted concatenation of each group's members, as hex-safe binary with its digest."""
    rows = F.sort_array(F.collect_list(F.struct("member", F.hex("content").alias("h"))))
    whole = F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), ""))
    return members.groupBy(*by).agg(whole.alias("content")).withColumn("sha256", F.sha2("content", 256))


def member_csv(members: DataFrame, schema: str) -> DataFrame:
    """Rows of CSV members, header line skipped."""
    lines = members.select("member", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("i", "line")).where("i > 0 and line <> ''")
    return lines.select("member", F.from_csv("line", schema).alias("r")).select("member", "r.*")


def check_listing(present: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Files that are missing, or there without being on the list."""
    a, b = present.select(key).distinct().withColumn("_p", F.lit(1)), allowed.select(key).distinct().withColumn("_a", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("_p is null or _a is null").select(key, F.when(F.col("_p").isNull(), "missing").otherwise("not listed").alias("problem"))


def truncated_lines(spark: SparkSession, path: str, glob: str = "*", max_lines: int | None = None) -> DataFrame:
    """path, line_no, line of zstd text streams: whole lines up to a clean stop where the stream
    breaks off. max_lines is the feature's own limit for each stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rest, n = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True), b"", 0
                while max_lines is None or n < max_lines:
                    try:
                        more = reader.read(1 << 20)
                    except zstandard.ZstdError:
                        break
                    if not more:
                        break
                    *lines, rest = (rest + more).split(b"\n")
                    if lines := lines[: None if max_lines is None else max_lines - n]:
                        yield pa.RecordBatch.from_pydict({"path": [p] * len(lines), "line_no": pa.array(range(n, n + len(lines)), pa.int64()), "line": [x.decode("utf-8", "replace") for x in lines]})
                        n += len(lines)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(work, "path string, line_no long, line string")


def verify_pins(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """Problems of pinned sources (name, sha256): missing, not pinned, or of another content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("own"))
    both = have.join(pins.select("name", "sha256"), "name", "full_outer")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "not pinned").when(F.col("own") != F.col("sha256"), "content differs")
    return both.select("name", problem.alias("problem")).where("problem is not null")


# Fixed-width navigation products.

#: Names of a navigation record's numbers, in order of their places.
NAV_FIELDS = [
    "af0", "af1", "af2", "iode", "crs", "delta_n", "m0", "cuc", "e", "cus", "sqrt_a", "toe", "cic", "omega0", "cis", "i0", "crc", "omega", "omega_dot",
    "idot", "l2codes", "week", "l2p", "ura", "health", "tgd", "iodc", "ttm", "fit",
]
NO_CLOCK = 999999.0


def field(line: Column, start: int, width: int) -> Column:
    """A fixed-width number, D or E exponent, null where it is blank."""
    return F.translate(F.trim(F.substring(line, start + 1, width)), "Dd", "Ee").try_cast("double")


def calendar(parts: list[Column]) -> Column:
    y, mo, d, h, mi, s = (p.cast("int") for p in parts)
    return F.make_timestamp_ntz(y, mo, d, h, mi, s)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (line number), line: whole files, since records span lines."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def navigation_records(spark: SparkSession, path: str, system: str = "G") -> DataFrame:
    """One row a broadcast record: prn, toc, and NAV_FIELDS. A record is a head line and seven more;
    lines find their record by their head's number, no window over the file."""
    raw = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))
    head = rf"^{system}(\d\d) (\d{{4}}) (\d\d) (\d\d) (\d\d) (\d\d) (\d\d)"
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 8), lambda i: F.get(F.col("l"), i).rlike(head))
    rec = raw.where(F.size("l") >= 8).select(F.explode(F.transform(starts, lambda i: F.slice("l", i + 1, 8))).alias("r"))
    part = lambda k: F.regexp_extract(F.col("r")[0], head, k)
    places = [(0, 23), (0, 42), (0, 61)] + [(j, at) for j in range(1, 8) for at in (4, 23, 42, 61)]
    values = [field(F.col("r")[j], at, 19) for j, at in places]
    return rec.select(part(1).cast("int").alias("prn"), calendar([part(k) for k in range(2, 8)]).alias("toc"), *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(NAV_FIELDS, values, strict=False)])


def precise_orbits(spark: SparkSession, path: str, system: str = "G") -> DataFrame:
    """prn, sow, x, y, z (metres), clk (seconds) of an SP3 file; a missing clock drops the row."""
    raw = spark.read.text(path, wholetext=True).select(F.split("value", r"\n(?=\*)").alias("epochs"))
    e = raw.select(F.explode("epochs").alias("e")).where(F.col("e").startswith("*")).select(F.split("e", "\r?\n").alias("l"))
    t = F.split(F.trim(F.substring(F.col("l")[0], 2, 80)), r"\s+")
    rows = e.select(calendar([t[i] if i < 5 else t[5].cast("double") for i in range(6)]).alias("ts"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("r")).where(F.col("r").startswith("P" + system))
    x = rows.select(F.substring("r", 3, 2).try_cast("int").alias("prn"), seconds_of_week(F.col("ts")).alias("sow"), *[(field(F.col("r"), at, 14) * 1000.0).alias(n) for n, at in (("x", 4), ("y", 18), ("z", 32))], field(F.col("r"), 46, 14).alias("clk"))
    return x.where(F.abs("clk") <= NO_CLOCK).where("prn is not null and x is not null").withColumn("clk", F.col("clk") * 1e-6)


def precise_clocks(spark: SparkSession, path: str, system: str = "G") -> DataFrame:
    """prn, sow, bias (seconds) of a clock file's AS lines."""
    p = spark.read.text(path).where(F.col("value").startswith("AS " + system)).select(F.split("value", r"\s+").alias("p")).where(F.size("p") >= 10)
    c = F.col("p")
    rows = p.select(F.substring(c[1], 2, 3).try_cast("int").alias("prn"), calendar([c[2], c[3], c[4], c[5], c[6], c[7].cast("double")]).alias("ts"), F.translate(c[9], "Dd", "Ee").try_cast("double").alias("bias"))
    return rows.select("prn", seconds_of_week(F.col("ts")).alias("sow"), "bias").where("prn is not null and bias is not null")

