"""Benchmark decontamination by winnowing.

Of each 6 neighbouring 5-word grams the one with the least hash is kept, in documents and benchmark
items alike, so any shared span of 10 words shares a kept gram. Kept grams are the fingerprints: those
of documents are joined with those of items, and around each hit the 10-word windows that hold the
gram are joined with the items' windows, word for word, which extends a hit to the whole shared span.
Items shorter than a window are one window and one fingerprint of their own length.

The corpus is read once and its texts are never shuffled: what a bit map of the benchmark's
fingerprints (MAP_BITS at most) holds goes on as candidates, with the windows' words. The map only
narrows; both joins are equi-joins that Spark plans by the sizes of written tables.

Defined cases: null text has no words (no hits, not contaminated; an item without words is never
found); null item_id is ignored; repeated items count once by item_id; repeated documents give equal
rows; texts are read whole; extra columns are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NOT_WORD, U64, Words, class_table, materialise, mix, text_bytes, text_slices

WINDOW = 10
GRAM = 5
#: Bits of the map of the benchmark's fingerprints (a power of two): 16 MiB at most.
MAP_BITS = 27
#: The map is made in so many parts, and an entry sets so many bits of its part at most.
MAP_PARTS = 64
MAX_PROBES = 4
CLASSES = class_table(NOT_WORD, lower=True)


def winnow(grams: np.ndarray, doc_of: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Places of the kept grams: the least of each `span` neighbours within a document."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    hashes = np.where(valid, grams, ~U64(0))
    best = np.arange(n)
    low = hashes.copy()
    for j in range(1, min(span, n)):
        other = hashes[j:]
        less = other < low[: n - j]
        best[: n - j][less] = np.flatnonzero(less) + j
        low[: n - j][less] = other[less]
    begins = valid.copy()  # windows of `span` valid grams of one document
    if n >= span:
        begins[: n - span + 1] &= valid[span - 1 :] & (doc_of[: n - span + 1] == doc_of[span - 1 :])
    begins[max(0, n - span + 1) :] = False
    return np.unique(best[begins])


def phrase(code: bytes, w: Words, at: int, size: int) -> bytes:
    return b" ".join(code[a:b] for a, b in zip(w.start[at : at + size].tolist(), w.end[at : at + size].tolist(), strict=True))


def kept_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept grams of a slice."""
    grams, valid = w.grams(GRAM)
    at = winnow(grams, owners(w), valid, WINDOW - GRAM + 1)
    return at, grams[at]


def owners(w: Words) -> np.ndarray:
    """The text that each word is of."""
    return np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))


def phrases(w: Words, at: np.ndarray, size: int) -> list[str]:
    code = w.code.tobytes() if len(at) else b""
    return [phrase(code, w, p, size).decode() for p in at.tolist()]


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """size, phrase, item_id of the items' windows; and the items' distinct fingerprints with the size
    of the windows that they stand for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            w = Words(*text_bytes(batch.column(1)), CLASSES)
            owner, length = owners(w), np.diff(w.doc)
            for size in np.unique(np.minimum(length[length > 0], WINDOW)).tolist():
                grams, valid = w.grams(size)
                at = np.flatnonzero(valid & (np.minimum(length, WINDOW) == size)[owner])
                kept = kept_grams(w) if size == WINDOW else (at, grams[at])
                kind = np.concatenate([np.ones(len(at), bool), np.zeros(len(kept[0]), bool)])
                n = len(kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kind), pa.array(np.full(n, size, np.int32)), pa.array(phrases(w, at, size) + [None] * len(kept[0]), pa.string()),
                        batch.column(0).take(pa.array(owner[np.concatenate([at, kept[0]])])), pa.array(np.concatenate([np.zeros(len(at), np.int64), kept[1].view(np.int64)])),
                    ],
                    names=["window", "size", "phrase", "item_id", "print"],
                )

    made = materialise(items.mapInArrow(work, "window boolean, size int, phrase string, item_id string, print long"), "benchmark")
    windows = materialise(made.where("window").select("size", "phrase", "item_id").distinct(), "benchmark_windows")
    return windows, materialise(made.where("not window").select("size", "print").distinct(), "benchmark_prints")


class PrintMap(NamedTuple):
    """Which fingerprints may be the benchmark's: a Bloom filter in parts of `width` bits."""

    bits: bytes
    probes: int

    def holds(self, prints: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits, np.uint8)
        width = len(bits) * 8 // MAP_PARTS
        base = part_of(prints) * width
        out = np.ones(len(prints), bool)
        for j in range(self.probes):
            at = base + slot_of(prints, j, width)
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def part_of(prints: np.ndarray) -> np.ndarray:
    return (prints % U64(MAP_PARTS)).astype(np.int64)


def slot_of(prints: np.ndarray, probe: int, width: int) -> np.ndarray:
    return (mix(prints ^ U64(probe + 1)) >> U64(64 - width.bit_length() + 1)).astype(np.int64)


def print_map(prints: DataFrame) -> PrintMap:
    n = prints.count()
    bits = 1 << min(MAP_BITS, max(16, (16 * n).bit_length()))
    width, probes = bits // MAP_PARTS, int(np.clip(round(0.69 * bits / max(1, n)), 1, MAX_PROBES))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        own = group["print"].to_numpy().view(U64)
        held = np.zeros(width, np.uint8)
        for j in range(probes):
            held[slot_of(own, j, width)] = 1
        return pd.DataFrame({"part": [int(part_of(own[:1])[0])], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros((MAP_PARTS, width // 8), np.uint8)
    unsigned = F.pmod(F.col("print"), F.lit(MAP_PARTS))  # a power of two, so the same for signed numbers
    for row in prints.groupBy(unsigned.alias("part")).applyInPandas(work, "part long, bits binary").collect():  # the map, no more than its fixed size
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return PrintMap(out.tobytes(), probes)


SCANNED = "row long, doc_id long, text_hash long, n_words long, candidates array<struct<print:long,start:int,size:int,phrase:string>>"


def scan(docs: DataFrame, found: PrintMap, short: list[int]) -> DataFrame:
    """A row per document with its candidates: fingerprints in the map, each with the windows that it
    is a part of. row: a number of its own."""
    held = docs.sparkSession.sparkContext.broadcast((found, short))  # MAP_BITS at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (found, short), row = held.value, TaskContext.get().partitionId() << 33
        for batch in text_slices(batches):
            w = Words(*text_bytes(batch.column(1)), CLASSES)
            n = len(w.start)
            starts, sizes, prints, texts = [], [], [], []
            for size in [*short, WINDOW]:
                if size == WINDOW:
                    at, own = kept_grams(w)
                    _, valid = w.grams(WINDOW)
                    hit = found.holds(own)
                    reach = WINDOW - GRAM + 1
                    start, own = (at[hit][:, None] - np.arange(reach)).ravel(), np.repeat(own[hit], reach)
                    owner = np.repeat(at[hit], reach)
                    first = np.repeat(w.doc[:-1], np.diff(w.doc))
                    inside = start >= first[owner] if n else np.zeros(0, bool)
                    start, own = start[inside], own[inside]
                    fits = valid[start]
                    start, own = start[fits], own[fits]
                else:
                    grams, valid = w.grams(size)
                    start = np.flatnonzero(valid)
                    start = start[found.holds(grams[start])]
                    own = grams[start]
                starts.append(start)
                sizes.append(np.full(len(start), size, np.int32))
                prints.append(own)
                texts += phrases(w, start, size)
            start, size, own = np.concatenate(starts).astype(np.int64), np.concatenate(sizes), np.concatenate(prints).view(np.int64)
            doc = owners(w)[start] if n else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(len(batch) + 1))
            entries = pa.StructArray.from_arrays(
                [pa.array(own[order]), pa.array((start - (w.doc[doc] if n else 0))[order].astype(np.int32)), pa.array(size[order]), pa.array(texts, pa.string()).take(pa.array(order))],
                names=["print", "start", "size", "phrase"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(batch))), batch.column(0), batch.column(2), pa.array(np.diff(w.doc)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)],
                names=["row", "doc_id", "text_hash", "n_words", "candidates"],
            )
            row += len(batch)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, SCANNED)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), n_words, n_hit, items (ids found, sorted as
    strings)."""
    windows, prints = benchmark_windows(benchmark)
    short = sorted(r["size"] for r in prints.select("size").distinct().collect() if r["size"] < WINDOW)  # nine at most
    scanned = materialise(scan(docs, print_map(prints.select("print").distinct()), short), "scanned")
    candidates = scanned.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    met = candidates.join(prints, ["size", "print"], "left_semi")
    found = met.join(windows, ["size", "phrase"]).groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))
    hits = found.select(F.col("row").alias("hit_row"), words.cast("long").alias("n_hit"), "items")
    joined = scanned.select("row", "doc_id", "text_hash", "n_words").join(hits, F.col("row") == F.col("hit_row"), "left")
    return joined.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM iwin
), dwin AS (
  SELECT row_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hit AS (SELECT row_id, i, size, item_id FROM dwin JOIN iwin USING (size, g)
), words AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row_id, i, size FROM hit)) GROUP BY row_id
), items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT row_id, item_id FROM hit) GROUP BY row_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""
