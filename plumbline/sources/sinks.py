"""Sinks: canonical JSON, JSON-line appends, column files, rendered pages of small results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.textnum import canonical


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write through Spark's file system: to a temporary name, then renamed over the target."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} cannot be put in place")
    return path


def result_json(df: DataFrame, path: str) -> str:
    """A result of one row as canonical JSON (sorted keys, no NaN), with a line end."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a result document holds exactly one row")
    return put_text(df.sparkSession, path, canonical(rows[0].asDict(recursive=True)) + "\n")


def append_lines(df: DataFrame, path: str) -> str:
    """Append rows as JSON lines; earlier files are never touched."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)
    return path


def columns(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def markdown_table(df: DataFrame, limit: int) -> str:
    """The first rows of a report (a top-k by design) as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["" if v is None else v for v in r]) for r in rows]]) + "\n"


def html_table(df: DataFrame, limit: int) -> str:
    rows = df.limit(limit).collect()
    cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs) + "</tr>"
    return "<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in rows) + "</table>\n"


def svg_curve(points: list[tuple[float, float]], width: int = 320, height: int = 160) -> str:
    """A small line chart of a handful of points."""
    xs, ys = zip(*points, strict=True)
    fit = lambda v, lo, hi, size: (v - lo) / ((hi - lo) or 1) * (size - 20) + 10
    line = " ".join(f"{fit(x, min(xs), max(xs), width):.1f},{height - fit(y, min(ys), max(ys), height):.1f}" for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{line}"/></svg>\n'


def fill(template: str, values: dict[str, object]) -> str:
    """A card from a template's {{name}} marks; a mark without a value is an error."""
    import re

    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]), template)
