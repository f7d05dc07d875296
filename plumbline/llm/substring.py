"""Substring dedup by difference-cover anchors.

The residues {0, 1, 3} cover all differences modulo 7: of two equal spans of 13 words, at any two
places, some word at the same distance (0 to 6) into both lies at a covered place, and the 7 words
from there on are in both spans. So hashes of 7-word windows at covered places alone (3 of 7) find
every shared span of 13 words.

Documents are dealt to units of some 4 MiB, once; all passes read that one exchange. Pass A sends
each unit's anchors, once per unit, to buckets; a bucket returns one bit an anchor: whether
another document has it. Pass B extends: 13-word windows around shared anchors go to buckets by a
second, independent hash, so equality is judged on 64 bits and the bucket's bits together. A bucket
gives each window its least document and returns to a unit the hashes whose least document is
smaller than one of its own. Pass C marks the words of the unit's documents. Nothing goes through
the driver but the total size of the texts, and units, buckets and partitions follow that size.

An anchor travels as its bucket and 32 more bits. Anchors that merely agree in these make more
candidate windows (as buckets follow the input, about one in a thousand at any size), never other
results.

Defined cases: null text has no words; a null doc_id counts as larger than all others; rows of
equal doc_id are one document (their windows never remove one another's words); rows equal in
doc_id and text share a unit; extra columns are ignored; texts are read whole; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, WHITE, Words, class_table, marked, text_bytes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # fixed values: the perfect difference cover modulo 7
GRAM = WINDOW - PERIOD + 1
#: Bytes of text by unit, bucket and partition of an exchange.
UNIT_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
PARTITION_BYTES = 32 << 20
#: No fewer buckets and partitions than these.
LEAST = 64
#: Bits of an anchor beside its bucket's.
KEY_BITS = 32
SECOND_BASE = 0xD1342543DE82EF95
CLASSES = class_table(WHITE, lower=False)
LAST_ID = (1 << 63) - 1
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (covered modulo the period within their document) and hashes of the anchors."""
    grams, valid = w.grams(GRAM)
    place = np.arange(len(w.start)) - np.repeat(w.doc[:-1], np.diff(w.doc))
    at = np.flatnonzero(valid & np.isin(place % PERIOD, COVER))
    return at, grams[at]


def high(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> U64(64 - bits)


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in x, and its length."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)


def one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([c.cast(kind) for c in column.chunks]) if column.num_chunks else pa.array([], kind)


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


class Unit:
    """One unit's texts, words and document numbers."""

    def __init__(self, rows: pa.Table):
        self.number = rows.column("unit")[0].as_py() if len(rows) else None
        self.ids = one(rows.column("doc_id"), pa.int64())
        self.texts = one(rows.column("text"), pa.string())
        self.words = Words(*text_bytes(self.texts), CLASSES)

    def owners(self, at: np.ndarray) -> np.ndarray:
        numbers = self.ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        return np.repeat(numbers, np.diff(self.words.doc))[at]

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The anchors in order of their keys: places, the distinct keys, where each begins, their buckets' cuts."""
        at, hashes = anchors(self.words)
        keys = high(hashes, bits + KEY_BITS)
        order = np.argsort(keys, kind="stable")
        first = runs_of(keys[order])
        distinct = keys[order][first[:-1]]
        return at[order], distinct, first, runs_of(distinct >> U64(KEY_BITS))


def send_anchors(rows: pa.Table, bits: int) -> pa.Table:
    """By bucket: the unit's distinct anchors, and a bit for those that two of its documents have."""
    unit = Unit(rows)
    at, keys, first, cuts = unit.keys(bits)
    owner = unit.owners(at)
    twice = np.minimum.reduceat(owner, first[:-1]) < np.maximum.reduceat(owner, first[:-1]) if len(keys) else np.zeros(0, bool)
    packed = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    bucket = (keys[cuts[:-1]] >> U64(KEY_BITS)).astype(np.int64)
    return pa.table([pa.array(np.full(len(bucket), unit.number or 0, np.int64)), pa.array(bucket), blobs(keys.astype(np.uint32), cuts), pa.array(packed, pa.binary())], names=["unit", "bucket", "keys", "twice"])


def shared_anchors(rows: pa.Table) -> pa.Table:
    """What a bucket answers to each unit: a bit for each anchor it sent, where any is shared."""
    parts = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows.column("twice").to_pylist(), parts, strict=True)])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    first = runs_of(keys[order])
    copies = np.add.reduceat(1 + twice[order].astype(np.int64), first[:-1])
    shared = np.empty(len(keys), bool)
    shared[order] = np.repeat(copies > 1, np.diff(first))
    ends = np.cumsum([0] + [len(p) for p in parts])
    bits = [np.packbits(shared[a:b]).tobytes() if shared[a:b].any() else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = pa.table([one(rows.column("unit"), pa.int64()), one(rows.column("bucket"), pa.int64()), pa.array(bits, pa.binary())], names=["unit", "bucket", "bits"])
    return out.filter(out.column("bits").is_valid())


def send_windows(rows: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """By bucket: the unit's windows around shared anchors, each once, with its least and greatest document."""
    unit = Unit(rows)
    w, n = unit.words, len(unit.words.start)
    at, keys, first, cuts = unit.keys(bits)
    told = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    shared = np.zeros(len(keys), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if (held := told.get(int(keys[a]) >> KEY_BITS)) is not None:
            shared[a:b] = np.unpackbits(np.frombuffer(held, np.uint8), count=b - a)
    at = at[np.repeat(shared, np.diff(first))]
    grams, valid = w.grams(WINDOW)
    near = np.flatnonzero(marked(n, np.maximum(at - (WINDOW - GRAM), 0), at + 1) & valid) if n else np.zeros(0, np.int64)
    hashes, owner = grams[near], unit.owners(near)
    number = high(w.grams(WINDOW, SECOND_BASE)[0][near], bits)
    order = np.lexsort((hashes, number))
    hashes, number, owner = hashes[order], number[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])))) if len(hashes) else np.zeros(0, np.int64)
    low, top = (f.reduceat(owner, new) if len(new) else owner for f in (np.minimum, np.maximum))
    hashes, number = hashes[new], number[new].astype(np.int64)
    cuts = runs_of(number)
    return pa.table(
        [pa.array(np.full(len(cuts) - 1, unit.number or 0, np.int64)), pa.array(number[cuts[:-1]]), blobs(hashes, cuts), blobs(low, cuts), blobs(top, cuts)],
        names=["unit", "bucket", "hashes", "low", "top"],
    )


def least_documents(rows: pa.Table) -> pa.Table:
    """What a bucket answers to each unit: hashes that some smaller document has, and the least."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    parts = read("hashes", U64)
    hashes, low, top = np.concatenate(parts), np.concatenate(read("low", np.int64)), np.concatenate(read("top", np.int64))
    order = np.argsort(hashes, kind="stable")
    first = runs_of(hashes[order])
    least = np.empty(len(hashes), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], first[:-1]), np.diff(first))
    keep = least < top
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[keep]
    cuts = np.searchsorted(row, np.arange(len(parts) + 1))
    out = pa.table([one(rows.column("unit"), pa.int64()), blobs(hashes[keep], cuts), blobs(least[keep], cuts)], names=["unit", "hashes", "least"])
    return out.filter(pa.array(np.diff(cuts) > 0))


def settle(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Mark the words of one unit's documents."""
    unit = Unit(rows)
    w = unit.words
    known = np.frombuffer(b"".join(answers.column("hashes").to_pylist()), U64)
    least = np.frombuffer(b"".join(answers.column("least").to_pylist()), np.int64)
    gone = np.zeros(len(w.start), bool)
    if len(known):
        order = np.argsort(known, kind="stable")
        known, least = known[order], least[order]
        grams, valid = w.grams(WINDOW)
        at = np.flatnonzero(valid)
        slot = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        at, slot = at[known[slot] == grams[at]], slot[known[slot] == grams[at]]
        hit = at[least[slot] < unit.owners(at)]
        gone = marked(len(w.start), hit, hit + WINDOW)
    n, removed, shas = [], [], []
    for text, a, b in zip(unit.texts.cast(pa.binary()).to_pylist(), w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        words = (text or b"").split()
        kept = [x for x, r in zip(words, gone[a:b].tolist(), strict=True) if not r] if gone[a:b].any() else words
        n.append(len(words))
        removed.append(len(words) - len(kept))
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table([unit.ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=[c.split()[0] for c in OUT.split(", ")])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0  # one number
    units, partitions = 1 + total // UNIT_BYTES, max(LEAST, 1 + total // PARTITION_BYTES)
    bits = (max(LEAST, 1 + total // BUCKET_BYTES) - 1).bit_length()
    dealt = docs.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units))).repartition(partitions, "unit")

    def by_bucket(df: DataFrame, answer, schema: str) -> DataFrame:
        return df.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(answer, schema).repartition(partitions, "unit")

    sent = dealt.groupBy("unit").applyInArrow(lambda t: send_anchors(t, bits), "unit long, bucket long, keys binary, twice binary")
    told = by_bucket(sent, shared_anchors, "unit long, bucket long, bits binary")
    found = dealt.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(lambda t, a: send_windows(t, a, bits), "unit long, bucket long, hashes binary, low binary, top binary")
    least = by_bucket(found, least_documents, "unit long, hashes binary, least binary")
    return dealt.groupBy("unit").cogroup(least.groupBy("unit")).applyInArrow(settle, OUT)
