"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

A document becomes token ids and one end id; only documents longer than a sequence are cut, into
pieces of the full length with a shorter one first. The histogram of piece lengths (at most
`capacity` entries whatever the corpus) goes to the driver, which repeats: list the patterns of two
to four lengths that fill a sequence exactly and that the histogram can still supply, fit
non-negative repeat counts to it, keep the patterns of the largest counts (twice as many as there
are lengths), fit those again, round, and take them off. What no pattern takes is packed by best
fit, longest first. The plan holds ranges of ranks per length; executors give each piece its rank
and look its place up.

Defined cases: null text is empty text (one end id); null or repeated doc_id and repeated rows are
packed row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import materialise, text_slices

CAPACITY = 2048
END_ID = 0
#: Lengths in one pattern; the third may be there twice.
PATTERN_LENGTHS = 4
#: Steps of a fit over all patterns, and over those kept.
WIDE_STEPS, KEPT_STEPS = 12, 100
#: A pattern with less than this count is left for the next fit.
LEAST_COUNT = 0.25
#: Fitting ends when a round adds less than this share of the sequences before it.
LEAST_GAIN = 0.02
#: Where pieces over half a sequence are this share of the sequences that the tokens need, each
#: pattern has one of them.
LONG_SHARE = 0.9
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def pieces_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, piece, start, length of documents of so many ids; the first piece may be shorter."""
    count = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = (sizes - 1) % capacity + 1
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def nth_of(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's rank among those of its length, which `seen` counts on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    run = np.diff(first, append=len(ordered))
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(first, run) + seen[ordered]
    seen[ordered[first]] += run
    return out


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece, with its task and its rank among the task's pieces of that length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_slices(batches, size=tokens.SLICE_BYTES):
            made = encoder.encode(batch.column(1).fill_null("").to_pylist())
            sizes = np.diff(made.ends) + 1
            ids = np.full(int(sizes.sum()), END_ID, "<u4")
            owner = np.repeat(np.arange(len(sizes)), sizes - 1)
            ids[np.arange(len(made.ids)) + owner] = made.ids
            doc, piece, start, length = pieces_of(sizes, capacity)
            raw, at = memoryview(ids).cast("B"), 4 * ((np.cumsum(sizes) - sizes)[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(doc), part, np.int32), nth_of(length, seen)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names_of(PIECES))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES)


def patterns_of(left: np.ndarray, capacity: int) -> np.ndarray:
    """The patterns x >= y >= z (the last may be there twice) that fill a sequence and that `left`
    can supply once, as rows of four lengths (0: unused). They are listed over pairs x, y, so there
    are fewer than capacity^2 / 4 whatever the corpus."""
    lengths = np.flatnonzero(left[:capacity])
    have = left > 0
    have[0] = False
    x = lengths[lengths * 2 >= capacity]
    x = x[have[capacity - x]]
    out = [np.stack([x, capacity - x, 0 * x, 0 * x], 1)]
    for x in lengths[lengths * PATTERN_LENGTHS >= capacity]:
        y = lengths[(lengths <= x) & (lengths < capacity - x)]
        rest = capacity - x - y
        once = have[rest] & (rest <= y)
        half = rest // 2
        twice = (rest % 2 == 0) & have[half] & (half <= y)
        out.append(np.stack([np.full(once.sum(), x), y[once], rest[once], 0 * y[once]], 1))
        out.append(np.stack([np.full(twice.sum(), x), y[twice], half[twice], half[twice]], 1))
    patterns = np.concatenate(out)
    supplied = np.ones(len(patterns), bool)
    for column in patterns.T:
        supplied &= (column == 0) | ((patterns == column[:, None]).sum(1) <= left[column])
    return patterns[supplied].astype(np.int32)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares min |A x - h| by accelerated projected gradient; a row of A is a
    length, a column a pattern. Errors count by length: a long piece left over costs more room."""
    weight = np.sqrt(np.arange(len(histogram)) / len(histogram)) + 0.1
    weight[0] = 0
    columns = list(np.ascontiguousarray(patterns.T))

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, x, len(histogram)) for c in columns) * weight

    def backward(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[c] for c in columns)

    v = np.ones(len(patterns))
    for _ in range(10):
        v = backward(forward(v))
        scale = np.linalg.norm(v)
        v /= scale
    step, target = 1 / (1.05 * scale), histogram * weight
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * backward(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def fitted(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """One round: patterns and their counts, taken off `left`."""
    patterns, out = patterns_of(left, capacity), []
    long = int(left[capacity // 2 + 1 :].sum())  # no two of these share a sequence
    if long * capacity >= LONG_SHARE * int((left * np.arange(len(left))).sum()):
        patterns = patterns[patterns[:, 0] * 2 > capacity]  # they are the bound, so each sequence has one
    if not len(patterns):
        return out
    wide = fit_counts(patterns, left.astype(float), WIDE_STEPS)
    patterns = patterns[np.argsort(-wide, kind="stable")[: 2 * np.count_nonzero(left)]]
    counts = fit_counts(patterns, left.astype(float), KEPT_STEPS)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < LEAST_COUNT:
            break
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        if count := int(min(max(1, np.floor(counts[i])), (left[lengths] // times).min())):
            left[lengths] -= times * count
            out.append((tuple(int(x) for x in patterns[i] if x), count))
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: bins that hold the same are kept as one entry, and the
    least room that takes a length is found in a sorted list of the rooms there are."""
    free: dict[int, list[tuple]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, count: int) -> None:
        if count:
            if not free.get(room):
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((items, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            items, count = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            each = room // length
            full = min(count, left // each)
            put(room - each * length, (*items, *[length] * each), full)
            left, rest = left - full * each, count - full
            if rest and 0 < left < each:
                put(room - left * length, (*items, *[length] * left), 1)
                left, rest = 0, rest - 1
            put(room, items, rest)
        each = capacity // length
        put(capacity - each * length, (length,) * each, left // each)
        put(capacity - left % each * length, (length,) * (left % each), 1 if left % each else 0)
    return [(items, count) for groups in free.values() for items, count in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeat counts; every piece of the histogram is in exactly one. Of the rounds
    of fitting, as many are kept as need the fewest sequences with best fit for what they leave."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity], total, best = 0, 0, None
    while True:
        rest = best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity)
        needed = total + sum(count for _, count in rest)
        if best is None or needed <= best[0]:
            best = needed, len(out), rest
        new = fitted(left, capacity)
        gain = sum(count for _, count in new)
        out, total = out + new, total + gain
        if gain <= LEAST_GAIN * total:
            return out[: best[1]] + best[2]


def ranges(packs: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset, sequences from one rank to the next)."""
    rank, out, sequence = np.zeros(capacity + 1, np.int64), {}, 0
    for items, count in packs:
        offset = 0
        for length in items:
            out.setdefault(length, []).append((rank[length], sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def bases(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """A row per task: the first rank of each of its lengths, over tasks in order; and the histogram."""
    # one row for each task and length: far fewer than pieces, and no more than capacity per task
    per_task = materialise(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # the window holds a row per task, never a row per piece
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = per_task.select("part", "length", before.alias("base")).groupBy("part").agg(F.collect_list(F.struct("length", "base")).alias("b"))
    return listed.select("part", F.col("b.length").alias("lengths"), F.col("b.base").alias("bases")), histogram


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens."""
    pieces = materialise(tokenise(docs, tokenizer, capacity), "pieces")
    base, histogram = bases(pieces)
    places = ranges(plan(histogram, capacity), capacity)
    held = docs.sparkSession.sparkContext.broadcast(places)  # a row for each length of a pattern
    # a task's ranks come first, then its pieces; a task's pieces are at most what it read
    none = F.lit(None).cast("array<long>")
    own = pieces.select("part", F.lit(1).alias("kind"), *names_of(PIECES)[:5], "nth", none.alias("lengths"), none.alias("bases"))
    first = base.select("part", F.lit(0).alias("kind"), *[F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in [*names_of(PIECES)[:5], "nth"]], "lengths", "bases")
    dealt = first.unionAll(own).repartition("part").sortWithinPartitions("part", "kind")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = held.value
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            heads = np.flatnonzero(batch.column(1).to_numpy() == 0)
            for lo, hi in zip([0, *(heads + 1)], [*heads, len(batch)], strict=True):
                if hi > lo:
                    length = batch.column(5).slice(lo, hi - lo).to_numpy()
                    rank = batch.column(7).slice(lo, hi - lo).to_numpy() + ranks[length]
                    sequence, offset = located(plan_of, length, rank)
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[2:7]), pa.array(sequence), pa.array(offset)], names=names_of(PLACED))
                if hi < len(batch):
                    ranks[batch.column(8)[hi].values.to_numpy()] = batch.column(9)[hi].values.to_numpy()

    return dealt.mapInArrow(locate, PLACED)


def located(plan_of: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    by = np.argsort(length, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(length[by])) + 1):
        rows = plan_of[int(length[group[0]])]
        at = np.searchsorted(rows[:, 0], rank[group], "right") - 1
        sequence[group] = rows[at, 1] + rank[group] - rows[at, 0]
        offset[group] = rows[at, 2]
    return sequence, offset
