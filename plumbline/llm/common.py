"""Helpers shared by the training-data operators.

Text kernels work on whole Arrow buffers: a batch of texts is one byte array with document
offsets, words are found by a 256-entry class table, and word and window hashes are computed for
all words of the batch at once. Batches are cut by bytes, so memory does not follow row counts.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one kernel call works on (a longer single text makes a call of its own).
SLICE_BYTES = 4 << 20
U64 = np.uint64
#: Rows of an Arrow batch where whole texts go to Python and back: Spark's 10,000 are tens of MB, which a
#: task holds several times outside the heap.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have TEXT_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of its own on a single
    machine (as in tests), and an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            path = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getuid()}")
        else:
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs
    a re-read and not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # gone when the application ends
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(wanted: list[str], taken: list[str]) -> list[str]:
    """The wanted names, with as many underscores as keep them apart from those taken (in any case)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most `size` bytes of text or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = col.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        begin = 0
        while begin < len(batch):
            end = int(np.searchsorted(ends, ends[begin] + size, "right")) - 1
            end = min(max(end, begin + 1), len(batch))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, and the offsets of each (nulls are empty)."""
    col = pa.concat_arrays([col.fill_null("").cast(pa.large_binary())])
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def class_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte classes: 0 for a separator, else the (lower-cased) byte."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: `[^\x20\x09-\x0D]+`: what separates words of running text.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: letters, digits and all beyond ASCII stay.
NOT_WORD = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash depend on all bits of the sum."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a slice: byte range of each, a 64-bit hash, and each document's word range."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, classes: np.ndarray, hashes: bool = True):
        code = classes[data]
        inside = code != 0
        if code.size == 0 or not (inside.any()):
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.doc = np.zeros(len(ends), np.int64)
            self.code = code
            return
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = ends[(ends > 0) & (ends < len(code))]
        first[cuts] = inside[cuts]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, ends)
        self.code = code
        if hashes:
            size = self.end - self.start
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(begin, size)
            term = code[inside].astype(U64) * powers(0x9E3779B97F4A7C15, int(size.max()))[place]
            self.hash = mix(np.add.reduceat(term, begin) + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))

    def grams(self, k: int, base: int = 0xA24BAED4963EE407) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether they lie in one document."""
        n = len(self.start)
        if n < k:
            return np.zeros(n, U64), np.zeros(n, bool)
        total = np.zeros(n - k + 1, U64)
        for j, w in enumerate(powers(base, k)):
            total += self.hash[j : n - k + 1 + j] * w
        out = np.zeros(n, U64)
        out[: n - k + 1] = mix(total + U64(k))
        left = np.repeat(self.doc[1:], np.diff(self.doc)) - np.arange(n)
        return out, left >= k


def marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
