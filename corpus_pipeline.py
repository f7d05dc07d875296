"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, langid, linededup, packing, simhash
from plumbline.llm.common import fresh, materialise, small_batches, table

#: A document goes if no language has this share of its letters.
MIN_LANGUAGE_SHARE = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language has a third, go."""
    small_batches(spark)
    model = langid.learn(langid.learn_rows(docs))
    if not model.languages:  # nothing to judge by, so only texts without letters go
        return langid.lettered(docs)
    language, share, spans = fresh(list(langid.ADDED), docs.columns)
    judged = langid.identify(docs, model, [language, share, spans])
    return judged.where((F.col(language) != langid.UND) & (F.col(share) >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates leave the texts; a document that was nothing else goes."""
    lines, dropped = fresh(["n_lines", "n_dropped"], docs.columns)
    done = linededup.dedup(docs, counts=[lines, dropped])
    empty = (F.col(dropped) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return done.where(~empty).select(*docs.columns)


def without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without (or with only) the rows of the given doc_id and text hash. What is joined was
    written before, so its size is known and Spark joins accordingly."""
    doc, text_hash = fresh(["doc", "hash"], docs.columns)
    keys = keys.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash))
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col(doc)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(text_hash)), how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) one document stays: the one of
    least doc_id (null last), of those that share it the one of least text hash, and of equal rows one."""
    small_batches(spark)
    groups = materialise(simhash.similar_groups(docs.select("doc_id", "text")), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    stay = materialise(first.select("f.doc_id", "f.text_hash"), "stay")
    rows = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    own = rows["doc_id"].eqNullSafe(stay["doc_id"]) & (rows["text_hash"] == stay["text_hash"])
    gone = materialise(rows.join(stay, own, "left_anti").select("doc_id", "text_hash"), "gone")
    left = without(docs, gone)
    again = materialise(rows.join(stay, own, "left_semi").where("n > 1").select("doc_id", "text_hash"), "again")
    if not again.limit(1).count():
        return left
    (text_hash,) = fresh(["hash"], docs.columns)
    one = without(left, again, "left_semi").withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash])
    return without(left, again).unionAll(one.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    small_batches(spark)
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = materialise(found.where("n_hit > 0").select("doc_id", "text_hash").distinct(), "contaminated")
    return without(docs, hit)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: The tokenizer's ids and the fitted language model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
