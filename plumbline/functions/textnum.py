"""Numbers in documents, JSON paths, versions and names: what claims are checked with."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of numbers, of what is not a claim, and of the line that is skipped.
NUMBER = r"(?<![\w.])(-?\d+(?:\.\d+)?)(?:[eE]([+-]?\d+))?(?![\w])"
URL = r"(?:https?://|www\.)\S+"
GEOMETRY = r'\b(?:x|y|x1|x2|y1|y2|cx|cy|r|rx|ry|dx|dy|width|height|points|viewBox|offset|style)="[^"]*"'
HEX = r"\b[0-9a-fA-F]{16,}\b"
LIST_MARK = r"^(\s*)\d+([.)]\s)"
IGNORE = r"<!--\s*claimcheck:ignore-line\b"
HEADING = r"^#+ (\d{4}-\d{2}-\d{2})"


def scrub(line: Column) -> Column:
    """Addresses, geometry, long hex and list marks out of a line (columns may move)."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, URL, " "), GEOMETRY, " "), HEX, " ")
    return F.regexp_replace(out, LIST_MARK, "$1 $2")


def number_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line (from 1), token: the numbers of each line that is not to be ignored."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "_l")).where(~F.col("_l").rlike(IGNORE))
    return lines.select(*keys, (F.col("_i") + 1).alias("line"), F.explode(F.regexp_extract_all(scrub(F.col("_l")), F.lit(NUMBER), F.lit(1))).alias("token"))


def allowed(tokens: DataFrame, allow: DataFrame) -> DataFrame:
    """Tokens that are not on the list; an entry without a reason allows nothing."""
    return tokens.join(allow.where(F.length(F.trim("reason")) > 0).select(F.col("value").alias("token")), "token", "left_anti")


def dated_headings(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Per group: dated headings, the first and the last date."""
    found = df.select(*by, F.explode(F.regexp_extract_all(text, F.lit("(?m)" + HEADING), F.lit(1))).alias("_d"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"))


def resolve(doc, path: str):
    """Dotted path with list places (negative too), then one of |len, |head8, |count:field=value.
    Anything that is not there raises."""
    expr, _, op = path.partition("|")
    for part in filter(None, expr.split(".")):
        doc = doc[int(part)] if isinstance(doc, list) else doc[part]
    if op.startswith("count:"):
        field, _, want = op[6:].partition("=")
        return sum(str(x.get(field)) == want for x in doc)
    return {"": lambda: doc, "len": lambda: len(doc), "head8": lambda: str(doc)[:8]}[op]()


def json_path(doc: str, path: str) -> Column:
    """The resolved value as text, null where it does not resolve (which checks count as failed)."""

    @F.udf("string")
    def get(text: str | None, p: str | None) -> str | None:
        try:
            found = resolve(json.loads(text), p)
        except (KeyError, IndexError, TypeError, ValueError, AttributeError):
            return None
        return found if isinstance(found, str) else canonical(found)

    return get(F.col(doc), F.col(path))


def fixed_path(doc: Column, path: str, kind: str = "string") -> Column:
    """`$.a[0].b` over JSON text, inside the JVM."""
    return F.get_json_object(doc, path).cast(kind)


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def canonical_json(doc: str) -> Column:
    @F.udf("string")
    def get(text: str | None) -> str | None:
        try:
            return canonical(json.loads(text))
        except (TypeError, ValueError):
            return None

    return get(F.col(doc))


def leaves(value) -> list[float]:
    """Numbers in a nested value, and in its strings, but not booleans."""
    import re

    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, bool) or x is None:
            continue
        if isinstance(x, (int, float)):
            out.append(float(x))
        elif isinstance(x, str):
            out += [float(m.group(0)) for m in re.finditer(NUMBER, x)]
        else:
            todo += x.values() if isinstance(x, dict) else x
    return [x for x in out if math.isfinite(x)]


def numeric_leaves(df: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """keys, value: every number in a JSON text at any depth."""

    @F.udf("array<double>")
    def get(text: str | None) -> list[float]:
        try:
            return leaves(json.loads(text))
        except (TypeError, ValueError):
            return []

    return df.select(*keys, F.explode(get(F.col(doc))).alias("value"))


def version_array(text: Column) -> Column:
    """The leading numeric parts of a version, [0] where there is none."""
    parts = F.split(text, r"[.\-+]")
    numeric = F.transform(parts, lambda p: p.rlike("^[0-9]+$"))
    stop = F.array_position(numeric, F.lit(False))
    kept = F.transform(F.when(stop == 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))), lambda p: p.cast("int"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(0)))


def at_least(text: Column, floor: list[int]) -> Column:
    """Whether a version reaches a floor, part by part; of equal parts the longer is higher."""
    return version_array(text) >= F.array(*map(F.lit, floor))


def software_name(text: Column) -> Column:
    """The tool's name without its version: lower case, 40 long, `unknown` where nothing is left."""
    name = F.element_at(F.split(text, r"\s+v(?:er(?:sion)?)?\.?\s+", 2), 1)
    clean = F.substring(F.lower(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9+\-]+", " "))), 1, 40)
    return F.when(clean != "", clean).otherwise("unknown")


CLOCK = r"\[%clk (\d+):(\d+):(\d+(?:\.\d+)?)\]"
CONTROL = r"^(\d+)\+(\d+)$"


def clock_seconds(text: Column) -> Column:
    """All clock marks of a text, in seconds."""
    found = F.regexp_extract_all(text, F.lit(CLOCK), F.lit(0))
    group = lambda c, i: F.regexp_extract(c, CLOCK, i).cast("double")
    return F.transform(found, lambda c: group(c, 1) * 3600 + group(c, 2) * 60 + group(c, 3))


def time_control(text: Column) -> tuple[Column, Column]:
    """Base and increment of `base+inc`, null where it is not one."""
    return tuple(F.nullif(F.regexp_extract(text, CONTROL, i), F.lit("")).cast("int") for i in (1, 2))


def fresh(claims: DataFrame, text: str, pattern: str, current: str) -> DataFrame:
    """claims with `found` (the first group of the row's pattern in its text) and `fresh`: equal to
    the current value. No match fails."""
    found = F.nullif(F.call_function("regexp_extract", F.col(text), F.col(pattern), F.lit(1)), F.lit(""))
    return claims.withColumn("found", found).withColumn("fresh", F.coalesce(found == F.col(current), F.lit(False)))
