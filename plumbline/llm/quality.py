"""Quality rules with cross-document line frequency, in DataFrame operations only.

Per text: word, symbol, repeated-line and repeated-window counts. Across documents: normalised
lines are hashed and their distinct documents counted per host (the `source` column); lines in more
than `max_documents` documents of a host are boilerplate there, and a document whose words lie
mostly in such lines is depleted and rejected. A document counts by the hash of its whole text, so
exact copies of one text are one document (they are for the deduplicators, not for this rule) and
different texts never are, however many lines they share.

Defined cases: null text has no words (base_failed, not kept); null source is a host of its own;
repeated rows give equal rows; ties do not matter (counts only); extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: A line in more distinct documents of one host than this is boilerplate there.
MAX_DOCUMENTS = 30
#: A document is depleted if more than this share of its words lies in boilerplate lines.
MAX_REMOVED_PERCENT = 50
WHITE_CLASS = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_CLASS + "+"), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value) with value evaluated one time: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(w: Column, k: int = REPEAT_WINDOW) -> Column:
    """Words covered by k-word windows that occur twice or more in w; sorted, never pairwise."""
    n = F.size(w)
    hashes = once(w, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (k - 1)), lambda i: F.xxhash64(F.slice(v, i, k))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            size = F.size(s)
            twice = F.filter(
                F.transform(s, lambda x, j: F.when(((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])) | ((j < size - 1) & (F.get(s, F.least(j + 1, size - 1))["h"] == x["h"])), x["i"])),
                lambda x: x.isNotNull(),
            )
            return F.sort_array(twice)

        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        return once(ordered, lambda s: F.aggregate(places(s), start, lambda a, p: F.struct((p + k).alias("upto"), (a["n"] + p + k - F.greatest(p, a["upto"])).alias("n")), lambda a: a["n"]))

    return F.when(n < k + 1, 0).otherwise(once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0)


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one space, digit runs as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), WHITE_CLASS + "+", " "), "[0-9]+", "0"))


def boilerplate_words(docs: DataFrame, max_documents: int) -> DataFrame:
    """By document (doc_id, source, text hash): words in lines above the limit of its host."""
    def entry(x: Column) -> Column:
        return once(normal_line(x), lambda k: F.struct(F.xxhash64(k).alias("line"), F.size(words(x)).alias("n")))

    hashed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.transform(lines_of(F.col("text")), entry).alias("lines"))
    # the outer form: of the inner one Spark derives filters that would compute the lines again
    rows = hashed.select("doc_id", "source", "text_hash", F.posexplode_outer("lines").alias("pos", "l"))
    rows = materialise(rows.select("doc_id", "source", "text_hash", "pos", "l.line", "l.n").where("pos is not null"), "lines")
    seen = rows.groupBy("source", "line", "text_hash").agg(F.lit(1).alias("one"))
    common = seen.groupBy("source", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents)
    # few lines recur that often; written out, their size is known and Spark joins accordingly
    common = materialise(common.select(F.col("source").alias("c_source"), F.col("line").alias("c_line")), "common_lines")
    hit = rows.join(common, (F.col("line") == F.col("c_line")) & F.col("source").eqNullSafe(F.col("c_source")), "left_semi")
    # a line that a text has twice counts twice; a row that is there twice counts once
    per_line = hit.groupBy("doc_id", "source", "text_hash", "pos").agg(F.max("n").alias("n"))
    return per_line.groupBy("doc_id", "source", "text_hash").agg(F.sum("n").alias("removed"))


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    n_boilerplate_words."""
    docs = docs.select("doc_id", "text", "source")
    full = F.coalesce("text", F.lit(""))
    per_line = boilerplate_words(docs, max_documents).select(F.col("doc_id").alias("b_id"), F.col("source").alias("b_source"), F.col("text_hash").alias("b_hash"), "removed")
    stats = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        F.length(F.translate(full, WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        once(lines_of(full), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.explode_outer(F.transform(F.array(words(full)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))).alias("w"),
    )
    joined = stats.join(per_line, F.col("doc_id").eqNullSafe(F.col("b_id")) & F.col("source").eqNullSafe(F.col("b_source")) & (F.col("text_hash") == F.col("b_hash")), "left")
    n, repeated = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)
    removed = F.coalesce("removed", F.lit(0))
    return joined.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (removed * 100 <= n * max_removed_percent)).alias("kept"), removed.cast("long").alias("n_boilerplate_words"),
    )


def oracle(max_documents: int = MAX_DOCUMENTS, max_removed_percent: int = MAX_REMOVED_PERCENT) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT row_id, doc_id, source, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), win AS (
  SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT row_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 5) r(j) GROUP BY row_id
), ln AS (
  SELECT row_id, source, x, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS k
  FROM (SELECT row_id, source, unnest(l) AS x FROM w)
), common AS (
  SELECT ln.source, k FROM ln JOIN (SELECT row_id, md5(t) AS s FROM d) USING (row_id) GROUP BY ln.source, k HAVING count(DISTINCT s) > {max_documents}
), removed AS (
  SELECT row_id, sum(len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS n
  FROM ln JOIN common ON ln.k = common.k AND ln.source IS NOT DISTINCT FROM common.source GROUP BY row_id
), s AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n, 0) AS BIGINT) AS n_boilerplate_words
  FROM w LEFT JOIN rep USING (row_id) LEFT JOIN removed USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_boilerplate_words <= {max_removed_percent} * n_words AS kept,
  n_boilerplate_words
FROM s
"""
