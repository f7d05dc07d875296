"""Byte statistics of binary columns: carving, histograms, entropies, bit runs, alignments.

Histograms and words are array expressions inside the row. The whole 1108-column layout, and what
needs bits at all eight alignments, is one Arrow kernel over a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the feature layout.
PAIR_BUCKETS, RUN_BUCKETS, WINDOW, ALIGN_BINS = 256, 12, 64, 64
LAGS = (1, 2, 3, 4, 8, 16, 32, 64)
#: Names and widths of the layout's parts, in order.
LAYOUT = [("byte_hist", 256), ("pair_hist", 256), ("bit_runs", 24), ("ones", 1), ("entropy", 1), ("distinct", 1), ("window_entropy", 6), ("lags", 8), ("align_stats", 40), ("stored", 3), ("align_hist", 512)]
N_FEATURES = sum(n for _, n in LAYOUT)


def once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def carve(data: Column, size: int, margin: int = 64, lead: int = 8) -> Column:
    """The middle window of `size` bytes; null where the data is shorter than size + margin or the
    window would begin before `lead`."""
    start = F.floor((F.length(data) - size) / 2).cast("int")
    return F.when((F.length(data) >= size + margin) & (start >= lead), F.substring(data, start + 1, F.lit(size)))


def byte_values(data: Column) -> Column:
    """The bytes as an array of integers 0 to 255."""
    value = lambda b, i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int")
    return once(data, lambda b: F.when(F.length(b) > 0, F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: value(b, i))).otherwise(F.array().cast("array<int>")))


def entropy_of(values: Column) -> Column:
    """Shannon entropy in bits of an array of values; sorted once, so the cost is n log n."""
    def of(sorted_values: Column) -> Column:
        n = F.size(sorted_values)
        zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
        term = lambda k: F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0)
        step = lambda a, x: F.when(a["last"] == x, F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), (a["sum"] + term(a["run"])).alias("sum")))
        total = F.aggregate(sorted_values, zero, step, lambda a: a["sum"] + term(a["run"]))
        return F.when(n > 0, F.log2(n.cast("double")) - total / n)

    return once(F.array_sort(values), of)


def complement_words(values: Column) -> Column:
    """Places where two neighbouring little-endian 16-bit words are bitwise complements."""
    word = lambda v, i: F.get(v, i) + F.get(v, i + 1) * 256
    return once(values, lambda v: F.when(F.size(v) >= 8, F.size(F.filter(F.sequence(F.lit(0), F.size(v) - 4), lambda i: word(v, i).bitwiseXOR(word(v, i + 2)) == 65535))).otherwise(0))


def histogram_rows(df: DataFrame, key: str, values: str) -> DataFrame:
    """key, value, n out of an array column, pre-aggregated."""
    return df.select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count("*").alias("n"))


def _entropy(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(-1, keepdims=True), 1)
    p = counts / total
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def bit_run_histogram(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(2 * RUN_BUCKETS)
    if bits.size < 2:
        return out
    edge = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1], [True])))
    size = np.diff(edge)
    bucket = np.minimum(np.log2(size).astype(int), RUN_BUCKETS - 1) + bits[edge[:-1]].astype(int) * RUN_BUCKETS
    return np.bincount(bucket, minlength=2 * RUN_BUCKETS) / size.size


def lag_correlations(bits: np.ndarray) -> np.ndarray:
    x, out = bits.astype(float), []
    for k in LAGS:
        a, b = x[:-k], x[k:]
        flat = bits.size <= k or a.std() == 0 or b.std() == 0
        out.append(0.0 if flat else float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std())))
    return np.array(out)


def aligned_counts(bits: np.ndarray) -> np.ndarray:
    """Byte counts of the bit string read from each of the eight bit offsets (8 x 256)."""
    n = bits.size // 8 * 8
    out = np.zeros((8, 256))
    for off in range(8):
        part = bits[off : off + n - 8]
        if part.size >= 64:
            out[off] = np.bincount(np.packbits(part[: part.size // 8 * 8]), minlength=256)
    return out


def alignment_stats(counts: np.ndarray) -> np.ndarray:
    """Entropy, chi-square per byte, top share, top five's share, distinct share, by alignment."""
    total = counts.sum(1, keepdims=True)
    safe = np.maximum(total, 1)
    p, even = counts / safe, safe / 256
    top = np.partition(p, 251, axis=1)[:, 251:]
    stats = np.stack([_entropy(counts), ((counts - even) ** 2 / even).sum(1) / safe[:, 0], top.max(1), top.sum(1), (p > 0).mean(1)], 1)
    return np.where(total > 0, stats, 0).ravel()


def alignment_hist(counts: np.ndarray) -> np.ndarray:
    coarse = counts.reshape(8, ALIGN_BINS, -1).sum(2)
    return (coarse / np.maximum(coarse.sum(1, keepdims=True), 1)).ravel()


def features(data: bytes) -> np.ndarray:
    """All features of one fragment, in the order of LAYOUT."""
    a = np.frombuffer(data, np.uint8)
    n, bits = a.size, np.unpackbits(a)
    hist = np.bincount(a, minlength=256) / max(n, 1)
    pairs = np.bincount((a[:-1].astype(int) * 31 + a[1:]) % PAIR_BUCKETS, minlength=PAIR_BUCKETS) / max(n - 1, 1)
    grid = a[: n // WINDOW * WINDOW].reshape(-1, WINDOW)
    e = _entropy(np.stack([np.bincount(w, minlength=256) for w in grid])) if len(grid) >= 2 else None
    inside = [0.0] * 6 if e is None else [e.mean(), e.std(), e.min(), e.max(), *np.percentile(e, [25, 75])]
    stored = np.zeros(3)
    if n >= 8:
        words = a[:-1].astype(int) | a[1:].astype(int) << 8
        hits = int(((words[:-2] ^ words[2:]) == 0xFFFF).sum())
        stored = np.array([hits, hits / n, (a == 0).sum() / n])
    counts = aligned_counts(bits)
    plain = [bits.mean() if n else 0.0, float(_entropy(hist)), (hist > 0).sum() / 256]
    return np.concatenate([hist, pairs, bit_run_histogram(bits), plain, inside, lag_correlations(bits), alignment_stats(counts), stored, alignment_hist(counts)])


_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
_RUN_BUCKET = np.minimum(np.log2(np.maximum(np.arange((1 << RUN_BUCKETS) + 1), 1)).astype(int), RUN_BUCKETS - 1)


def _sums(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of a value of each byte by document."""
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return upto[first + size] - upto[first]


def _window_entropies(a: np.ndarray, place: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mean, deviation, least, most and quartiles of the windows' entropies, by document."""
    out, per = np.zeros((len(size), 6)), size // WINDOW
    inside = place < (per * WINDOW)[doc]
    window = (np.cumsum(per) - per)[doc[inside]] + place[inside] // WINDOW
    counts = np.bincount(window * 256 + a[inside], minlength=int(per.sum()) * 256)
    log = np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1))
    e = np.log2(WINDOW) - log[counts].reshape(-1, 256).sum(1) / WINDOW
    owner = np.repeat(np.arange(len(size)), per)
    e = e[np.lexsort((e, owner))]
    many = np.flatnonzero(per >= 2)
    n, first = per[many], (np.cumsum(per) - per)[many]
    total = np.bincount(owner, e, len(size))[many]
    mean = total / n
    spread = np.bincount(owner, (e - np.repeat(np.bincount(owner, e, len(size)) / np.maximum(per, 1), per)) ** 2, len(size))[many]

    def quantile(q: float) -> np.ndarray:
        at = q * (n - 1)
        low = np.floor(at).astype(int)
        lo, hi = e[first + low], e[first + np.minimum(low + 1, n - 1)]
        return lo + (hi - lo) * (at - low)

    out[many] = np.stack([mean, np.sqrt(spread / n), e[first], e[first + n - 1], quantile(0.25), quantile(0.75)], 1)
    return out


def _lags(a: np.ndarray, first: np.ndarray, size: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Correlations of the bits with the bits k further on, from counts of ones alone. inside: bytes
    that are not the last of their document."""
    out = np.zeros((len(size), len(LAGS)))
    ones, n = _sums(_ONES[a], first, size), size * 8
    for j, k in enumerate(LAGS):
        ahead, part = np.zeros(len(a), np.int64), k % 8
        step = k // 8
        reach = np.arange(step, len(a))
        same = np.repeat(first + size, size)[: max(len(a) - step, 0)] > reach if step else np.ones(len(a), bool)
        ahead[: max(len(a) - step, 0)] = np.where(same, a[step:], 0)
        if part:  # lags below a byte
            ahead = (ahead << part) & 255
            ahead[inside] |= a[inside + 1] >> (8 - part)
        both = _sums(_ONES[a & ahead.astype(np.uint8)], first, size)
        ok = n > k
        head, tail = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)  # ones in the first and last k bits
        for i in range(step + (part > 0)):
            here = ok & (size > i)
            take = 8 if i < step else part
            head[here] += _ONES[a[first[here] + i] >> (8 - take)]
            tail[here] += _ONES[a[first[here] + size[here] - 1 - i] & ((1 << take) - 1)]
        m = np.maximum(n - k, 1)
        x, y = (ones - tail) / m, (ones - head) / m
        sd = np.sqrt(np.maximum(x * (1 - x) * y * (1 - y), 0))
        ok &= sd > 0
        out[ok, j] = (both / m - x * y)[ok] / sd[ok]
    return out


def feature_rows(fragments: list[bytes]) -> np.ndarray:
    """features() of many fragments at once: a row each."""
    docs = len(fragments)
    a = np.frombuffer(b"".join(fragments), np.uint8)
    size = np.fromiter(map(len, fragments), np.int64, docs)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(docs), size)
    place = np.arange(len(a)) - first[doc]
    some = np.maximum(size, 1)[:, None]
    bytes_of = np.bincount(doc * 256 + a, minlength=docs * 256).reshape(docs, 256)
    pair = np.flatnonzero(place < (size - 1)[doc])
    value = a.astype(np.int64)
    mixed = (value[pair] * 31 + value[pair + 1]) % PAIR_BUCKETS
    pairs = np.bincount(doc[pair] * PAIR_BUCKETS + mixed, minlength=docs * PAIR_BUCKETS).reshape(docs, -1) / np.maximum(size - 1, 1)[:, None]
    bits = np.unpackbits(a)
    start = np.zeros(len(bits), bool)
    start[first[size > 0] * 8] = True
    start[1:] |= bits[1:] != bits[:-1]
    edge = np.flatnonzero(start)
    run = np.diff(edge, append=len(bits))
    bucket = _RUN_BUCKET[np.minimum(run, 1 << RUN_BUCKETS)] + bits[edge] * RUN_BUCKETS
    runs = np.bincount(doc[edge // 8] * 2 * RUN_BUCKETS + bucket, minlength=docs * 2 * RUN_BUCKETS).reshape(docs, -1).astype(float)
    runs /= np.maximum(runs.sum(1, keepdims=True), 1)
    ones = _sums(_ONES[a], first, size) / (8 * some[:, 0])
    hist = bytes_of / some
    plain = np.stack([ones, _entropy(bytes_of), (bytes_of > 0).sum(1) / 256], 1)
    wide = value[pair] * 256 + value[pair + 1]
    long = size > 8
    aligned = np.stack([np.bincount(doc[pair] * 256 + ((wide << off >> 8) & 255), minlength=docs * 256).reshape(docs, 256) for off in range(8)], 1) * long[:, None, None]
    four = np.flatnonzero(place < (size - 3)[doc])
    hit = ((a[four] ^ a[four + 2]) == 255) & ((a[four + 1] ^ a[four + 3]) == 255)
    hits = np.bincount(doc[four], hit, docs)
    stored = np.stack([hits, hits / some[:, 0], bytes_of[:, 0] / some[:, 0]], 1) * (size >= 8)[:, None]
    flat = aligned.reshape(docs * 8, 256).astype(float)
    coarse = flat.reshape(docs * 8, ALIGN_BINS, -1).sum(2)
    binned = (coarse / np.maximum(coarse.sum(1, keepdims=True), 1)).reshape(docs, -1)
    return np.concatenate([hist, pairs, runs, plain, _window_entropies(a, place, size, doc), _lags(a, first, size, pair), alignment_stats(flat).reshape(docs, -1), stored, binned], 1)


#: Bytes that one call of the kernel works on (a longer fragment makes a call of its own).
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512


def with_features(df: DataFrame, data: str, key: str) -> DataFrame:
    """key and the feature vector (array<float>) of each binary value; null data gives null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            upto = np.cumsum([len(x or b"") for x in rows])
            lo = 0
            while lo < len(rows):
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, "right"))
                hi = min(max(hi, lo + 1), lo + SLICE_ROWS)
                part = rows[lo:hi]
                made = feature_rows([x for x in part if x is not None]).astype(np.float32)
                there = np.array([x is not None for x in part])
                ends = np.concatenate(([0], np.cumsum(there * N_FEATURES))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()), mask=pa.array(~there))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[key, "features"])
                lo = hi

    return df.select(F.col(key).cast("long"), F.col(data).cast("binary").alias("data")).mapInArrow(work, f"{key} long, features array<float>")


def part_of(name: str) -> tuple[int, int]:
    """First place (from 0) and width of a part of the layout."""
    at = 0
    for part, width in LAYOUT:
        if part == name:
            return at, width
        at += width
    raise KeyError(name)


def family(features_col: str, names: list[str]) -> Column:
    """Projection on named feature families."""
    return F.concat(*[F.slice(features_col, at + 1, width) for at, width in map(part_of, names)])


#: Compressions that the standard library offers, as (name, implementation, level).
RECIPES = [(f"zlib-{i}", "zlib", i) for i in range(1, 10)]


def compressed(df: DataFrame, data: str, level: str) -> DataFrame:
    """df with `stream`: the raw DEFLATE stream of the data at the row's level (0 to 9)."""

    @F.pandas_udf("binary")
    def deflate(x: pd.Series, levels: pd.Series) -> pd.Series:
        import zlib

        def one(raw: bytes | None, at: int) -> bytes | None:
            if raw is None:
                return None
            c = zlib.compressobj(int(at), zlib.DEFLATED, -15)
            return c.compress(raw) + c.flush()

        return pd.Series([one(r, at) for r, at in zip(x, levels, strict=True)])

    return df.withColumn("stream", deflate(F.col(data).cast("binary"), F.col(level).cast("int")))


def generated(spark, n: int, size: int, seed: int) -> DataFrame:
    """Seeded content of seven families (chunk_id, fam, data), made where it is needed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [
            lambda r: r.integers(0, 256, size, np.uint8), lambda r: np.repeat(r.integers(0, 256, size // 16 + 1, np.uint8), 16)[:size],
            lambda r: r.integers(97, 123, size, np.uint8), lambda r: np.frombuffer(" ".join(map(str, r.integers(0, 9999, size))).encode()[:size], np.uint8),
            lambda r: (np.cumsum(r.integers(-2, 3, size)) % 256).astype(np.uint8), lambda r: np.where(r.random(size) < 0.9, 0, r.integers(0, 256, size)).astype(np.uint8),
            lambda r: np.resize(r.integers(0, 256, 97, np.uint8), size),
        ]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [makers[i % 7](np.random.default_rng([seed, i])).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"f{i % 7}" for i in ids]), pa.array(rows, pa.binary())], names=["chunk_id", "fam", "data"])

    return spark.range(n).mapInArrow(work, "chunk_id long, fam string, data binary")
