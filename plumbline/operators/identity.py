"""Exact identity: exclusion and dedup with reasons, window runs, manifests, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_with_reasons(df: DataFrame, digest: str, order: list[str], excluded: DataFrame | None = None, run_flag: str | None = None) -> DataFrame:
    """df with `reason` (null: kept). Precedence: excluded content, shared run, duplicate of an
    earlier row (by `order`) that itself is not excluded. The first of equals is found by a
    pre-aggregated minimum, so a class of any size needs no task of its own."""
    # order columns decide; ties in all of them would leave the choice open, so they must be unique
    base = df.withColumn("_order", F.struct(*order))
    out = base.join(excluded.select(F.col(digest).alias("_x")).distinct(), F.col(digest) == F.col("_x"), "left") if excluded is not None else base.withColumn("_x", F.lit(None))
    first = out.groupBy(digest).agg(F.min("_order").alias("_first"))
    run = F.col(run_flag) if run_flag else F.lit(False)
    marked = out.join(first, digest)
    reason = F.when(F.col("_x").isNotNull(), "excluded").when(F.coalesce(run, F.lit(False)), "shared_run").when(F.col("_order") != F.col("_first"), "duplicate")
    return marked.withColumn("reason", reason).drop("_x", "_order", "_first")


def window_hashes(df: DataFrame, key: str, text: str, width: int, stride: int = 1) -> DataFrame:
    """key, pos, hash, constant: a row for each window of `width` bytes at every `stride`-th offset;
    constant windows (one byte) are flagged. Windows are cut inside the row, from bytes (where an
    offset costs nothing), so the text is never copied along with each window."""
    def cut(data: Column) -> Column:
        offsets = F.when(F.length(data) >= width, F.sequence(F.lit(0), F.length(data) - width, F.lit(stride)))
        return F.transform(offsets, lambda i: F.hex(F.substring(data, i + 1, F.lit(width))))

    held = df.select(key, F.element_at(F.transform(F.array(F.encode(F.col(text), "UTF-8")), cut), 1).alias("_w"))
    at = held.select(key, F.posexplode("_w").alias("pos", "_w"))
    return at.select(key, F.col("pos").cast("long").alias("pos"), F.md5("_w").alias("hash"), (F.col("_w") == F.repeat(F.left("_w", F.lit(2)), F.lit(width))).alias("constant"))


#: Windows that are sorted at once; a key of more is counted in classes of windows of about so many.
WINDOWS = 1 << 22


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of rows of 64-bit columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return h


def distinct_rows(group: np.ndarray, columns: list[np.ndarray], n: int) -> np.ndarray:
    """Distinct rows of 64-bit columns in each of n groups. Rows are sorted by a hash and compared; only
    where hashes of different rows meet are they sorted by themselves."""
    columns = [*columns, group.astype(np.uint64)]
    h = mixed(columns)
    order = np.argsort(h)
    if not len(h):
        return np.zeros(n, np.int64)
    near = h[order][1:] == h[order][:-1]
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    if (near & ~same).any():
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    return np.bincount(group[order][np.concatenate(([True], ~same))], minlength=n)


def count_windows(texts: list[bytes], group: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `width` bytes at every offset of the texts, and distinct ones, by group (from 0 on)."""
    n = group[-1] + 1
    raw = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    word = raw[:-8].astype(np.uint64)  # the 8 bytes from each offset on (zeros after the end)
    for i in range(1, min(8, width)):
        word |= raw[i : len(raw) - 8 + i].astype(np.uint64) << np.uint64(8 * i)
    size = np.array([len(t) for t in texts])
    own = np.maximum(size - width + 1, 0)
    start = np.repeat(np.cumsum(size) - size - (np.cumsum(own) - own), own) + np.arange(own.sum())
    of = np.repeat(np.array(group), own)
    at = [*range(0, width - 7, 8), *([width - 8] if width > 8 and width % 8 else [])] or [0]
    classes = -(-len(start) // WINDOWS)
    if classes <= 1:
        distinct = distinct_rows(of, [word[start + i] for i in at], n)
    else:
        part = np.concatenate([mixed([word[start[k : k + WINDOWS] + i] for i in at]) >> np.uint64(32) for k in range(0, len(start), WINDOWS)]) % np.uint64(classes)
        distinct = sum(distinct_rows(of[p], [word[start[p] + i] for i in at], n) for p in (np.flatnonzero(part == c) for c in range(classes)))
    return np.bincount(of, minlength=n), distinct


def window_counts(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n, n_distinct: windows of `width` bytes at every offset of a key's texts; a key without any
    has no row. Texts are dealt by key once, and windows never leave the task."""
    dealt = df.select(key, F.encode(F.col(text), "UTF-8").alias("_t")).where("_t is not null").repartition(key).sortWithinPartitions(key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            n, distinct = count_windows(texts, group, width)
            there = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind).take(pa.array(there)), pa.array(n[there]), pa.array(distinct[there])], names=[key, "n", "n_distinct"])

        texts, group, keys, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not keys or k != keys[-1]:
                    if size >= WINDOWS // 4:
                        yield out()
                        texts, group, keys, size = [], [], [], 0
                    keys.append(k)
                texts.append(t)
                group.append(len(keys) - 1)
                size += len(t)
        if keys:
            yield out()

    return dealt.mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, n long, n_distinct long")


def longest_runs(matched: DataFrame, key: str, pos: str) -> DataFrame:
    """Longest run of consecutive places per key (gaps and islands): key, run."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    runs = matched.select(key, pos, island.alias("_i")).groupBy(key, "_i").agg(F.count("*").alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("run"))


def shared_runs(df: DataFrame, pinned: DataFrame, key: str, text: str, width: int, min_run: int) -> DataFrame:
    """key, run, dropped: the longest run of aligned, non-constant windows that occur at any offset
    of a pinned text; a run of min_run or more drops the row."""
    known = window_hashes(pinned, key, text, width).select("hash").distinct()
    own = window_hashes(df, key, text, width, width).where("not constant")
    runs = longest_runs(own.join(known, "hash", "left_semi"), key, "pos")
    return df.select(key).join(runs, key, "left").select(key, F.coalesce("run", F.lit(0)).alias("run")).withColumn("dropped", F.col("run") >= min_run)


def split_duplicates(df: DataFrame, digest: str, part: str) -> DataFrame:
    """Per digest that more than one row has: rows, parts, and whether it straddles the split."""
    per = df.groupBy(digest).agg(F.count("*").alias("n"), F.count_distinct(part).alias("n_parts"))
    return per.where("n > 1").withColumn("straddles", F.col("n_parts") > 1)


def distinct_rate(df: DataFrame, group: str, digest: str) -> DataFrame:
    """Per group: rows, distinct contents, collision rate."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("n_distinct")).withColumn("collision_rate", F.lit(1.0) - F.col("n_distinct") / F.col("n"))


def hash_number(h: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def fingerprint(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Order-invariant: rows, and the sum of per-row digests."""
    row = hash_number(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])))
    return df.groupBy(*(group or [])).agg(F.count("*").alias("n_rows"), F.sum(row).alias("fingerprint"))


def manifest(df: DataFrame, keys: list[str], digest: str, group: str) -> DataFrame:
    """Per group a digest over its row digests in order; for small groups such as file lists."""
    rows = F.sort_array(F.collect_list(F.struct(*keys, digest)))
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(rows, lambda r: r[digest]), "\n"), 256).alias("manifest"))
