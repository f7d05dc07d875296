"""Line dedup by a log-template tree, in DataFrame operations only.

A line goes down a tree of fixed depth: token count, then its leading tokens, where a token with a
digit counts as a field. In a leaf that lines of enough documents reach, a token that too few
documents have at its place is a variable field; what stays is the line's template. Templates that
recur in enough documents are dropped from all of them, and so are lines that recur as they are.

How many documents make a token a constant is not one number: a low bar lets frequent field values
split a template, a high one loses the rare templates of a large leaf. So a line has a template for
each bar of a ladder (`min_documents`, doubled as often as its tokens reach, and CONSTANT_PERCENT of
the leaf's documents), and goes if any of them recurs.

Documents are counted by the hash of their text: exact copies of one text count once and keep their
text (whole copies are for the near-duplicate operators), and different texts never count as one.

Defined cases: null text stays null, without lines; lines without a word are kept and counted in
n_lines as all others; a line of fewer than `min_tokens` words is never a template; repeated rows
give equal rows; ties do not matter (counts only); extra columns are kept as they are, but one named
like a count gives way to it; an empty table gives no rows. Tokens part at spaces, tabs and the
other white space of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, materialise
from plumbline.llm.quality import once

LEADING_TOKENS = 3
MIN_TOKENS = 3
#: Distinct documents in which a template must recur.
MIN_DOCUMENTS = 20
#: The ladder's relative bar: a share of the leaf's documents.
CONSTANT_PERCENT = 5
#: A template needs this share of constants among its tokens without a digit, and more constants
#: than fields among all of them. Tokens with a digit are fields, never constants.
MIN_CONSTANT_PERCENT = 80
FIELD = "<*>"


def tokens(line: Column) -> Column:
    """What white space parts (a literal split, without a regular expression)."""
    return F.filter(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), lambda w: w != "")


def masked(t: Column) -> Column:
    return F.transform(t, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))


def leaf_of(t: Column) -> Column:
    return F.xxhash64(F.size(t), masked(F.slice(t, 1, LEADING_TOKENS)))


def placed_lines(docs: DataFrame, with_line: bool) -> DataFrame:
    """doc_id, text_hash, line_no, leaf (and the line) of lines with enough tokens."""
    def entry(x: Column, i: Column) -> Column:
        return once(tokens(x), lambda t: F.struct(i.alias("line_no"), F.size(t).alias("n"), leaf_of(t).alias("leaf"), *([x.alias("line")] if with_line else [])))

    lines = F.filter(F.transform(F.split("text", "\n"), entry), lambda e: e["n"] > 0)
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    # the outer form: of the inner one Spark derives filters that would compute the lines again
    rows = held.select("doc_id", "text_hash", F.explode_outer("lines").alias("e")).where(F.col("e.n") >= MIN_TOKENS)
    return rows.select("doc_id", "text_hash", "e.line_no", "e.leaf", *(["e.line"] if with_line else []))


def counted(rows: DataFrame, key: str, min_documents: int) -> DataFrame:
    """Keys that rows of enough distinct documents have, and how many; a hot key is spread by text first."""
    return rows.groupBy(key, "text_hash").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)


def mostly_fixed(constants: Column, n: Column, n_words: Column) -> Column:
    return (F.size(constants) * 100 >= n_words * MIN_CONSTANT_PERCENT) & (F.size(constants) * 2 > n)


def line_templates(constants: Column, n: Column, n_words: Column, relative: Column, min_documents: int) -> Column:
    """The templates of a line of n tokens, n_words without a digit, by the ladder's bars. constants: structs (place, key,
    documents) in order of place, where a key stands for a leaf, a place and a token."""
    most = F.array_max(F.transform(constants, lambda c: c["documents"]))
    doublings = F.floor(F.log2(most / F.lit(min_documents)) + 1e-9).cast("int")
    bars = F.transform(F.sequence(F.lit(0), doublings), lambda j: F.lit(min_documents) * F.pow(F.lit(2.0), j))
    bars = F.concat(bars, F.array(F.greatest(relative.cast("double"), F.lit(float(min_documents)))))
    forms = F.transform(bars, lambda bar: F.transform(F.filter(constants, lambda c: c["documents"] >= bar), lambda c: c["key"]))
    fixed = F.filter(forms, lambda f: mostly_fixed(f, n, n_words))
    return F.array_distinct(F.transform(fixed, lambda f: F.xxhash64(n, f)))


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, text_hash and the sorted places of the lines to drop."""
    leaves = materialise(counted(placed_lines(docs, False), "leaf", min_documents), "leaves")
    reached = placed_lines(docs, True).join(leaves, "leaf").withColumnRenamed("documents", "leaf_documents")
    t = tokens(F.col("line"))
    reached = materialise(reached.select("doc_id", "text_hash", "line_no", "leaf", "leaf_documents", F.xxhash64(t).alias("exact"), masked(t).alias("tokens")), "leaf_lines")
    line = ["doc_id", "text_hash", "line_no", "leaf_documents", "n", "n_words"]
    n_words = F.size(F.filter("tokens", lambda w: w != FIELD))
    placed = reached.select("doc_id", "text_hash", "line_no", "leaf_documents", "leaf", F.size("tokens").alias("n"), n_words.alias("n_words"), F.posexplode("tokens").alias("place", "token"))
    placed = placed.where(F.col("token") != FIELD).select(*line, "place", F.xxhash64("leaf", "place", "token").alias("key"))
    constant = materialise(counted(placed, "key", min_documents), "constants")
    # a set, as rows may be there twice; places that have no constant are fields
    by_line = placed.join(constant, "key").groupBy(*line).agg(F.array_sort(F.collect_set(F.struct("place", "key", "documents"))).alias("constants"))
    by_line = by_line.where(mostly_fixed(F.col("constants"), F.col("n"), F.col("n_words")))
    templates = line_templates(F.col("constants"), F.col("n"), F.col("n_words"), F.col("leaf_documents") * CONSTANT_PERCENT / 100, min_documents)
    formed = by_line.select("doc_id", "text_hash", "line_no", F.explode(templates).alias("template"))
    formed = materialise(formed.unionAll(reached.select("doc_id", "text_hash", "line_no", F.col("exact").alias("template"))), "line_templates")
    found = materialise(counted(formed, "template", min_documents).select("template"), "templates")
    return formed.join(found, "template", "left_semi").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, counts: list[str] | tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of docs, text without the dropped lines, and the counts of lines and dropped lines.
    Columns of docs that are named like the counts give way."""
    doc, text_hash, places = fresh(["doc", "hash", "places"], docs.columns)
    dropped = dropped_lines(docs.select("doc_id", "text"), min_documents).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("dropped").alias(places))
    joined = docs.join(dropped, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left")
    lines = F.split(docs["text"], "\n")

    def left(x: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: F.get(x, i))

    kept = F.when(F.col(places).isNull(), docs["text"]).otherwise(F.array_join(once(lines, left), "\n"))
    numbers = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(places), F.lit(0))]
    return joined.select(*[kept.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in counts], *[v.cast("long").alias(k) for k, v in zip(counts, numbers, strict=True)])
