"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is set if more than half of the shingle hashes have it. Equal fingerprints are
one node. Two nodes within the radius agree on all but `radius` of `blocks` bit blocks, so each
node is dealt out once under each choice of blocks that may differ, with the other bits as key:
exact, without a scan of all pairs. Within a key, bit planes are stored vertically (64 members a
word); distances to all members of a word grow at once in carry-save counters, and words whose
members all exceed the radius are abandoned. A key gives links to a tree over its members, not all
pairs. Components come from alternating star contraction over shuffled links.

Defined cases: null text counts as empty; a text without words has fingerprint zero, linked like
any other; null doc_id never names a component unless no other id is in it; repeated rows come back
as often as they came; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, discard, materialise, mix, powers, text_slices

SHINGLE_WORDS = 3
RADIUS = 2
BLOCKS = 6
SEED = 42
#: Members of one key that are compared as they are; larger keys are dealt out by further bits.
KEY_MEMBERS = 8192
#: Comparisons (member, word of 64 members) in work at once.
JOBS = 1 << 16


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a lower-cased text, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, U64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line, SEED)], U64)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    begins = [0, *ends]
    return np.fromiter((h(line[a : b - 1], SEED) for a, b in zip(begins, ends[k - 1 :], strict=False)), U64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(shingle_hashes(t or b"", shingle_words)) for t in texts], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits that stay when `radius` of the bit blocks are left out, for each choice of blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edge)]
    return [sum(part) - sum(part[i] for i in out) for out in itertools.combinations(range(blocks), radius)]


def within(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of members of the same group within the radius, by bit planes.

    fp is sorted by group. A word holds up to 64 members of one group; a job is one member against
    one word that holds later members."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    words = (size + 63) // 64
    word_of_group = np.concatenate(([0], np.cumsum(words)))
    place = np.arange(n) - np.repeat(first, size)
    own = np.repeat(word_of_group[:-1], size) + place // 64
    lane = (place % 64).astype(U64)
    member = np.full((int(word_of_group[-1]), 64), -1, np.int64)
    member[own, lane.astype(np.int64)] = np.arange(n)
    planes = np.zeros((64, len(member)), U64)
    held = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for b in range(64):
        np.bitwise_or.at(planes[b], own, held[:, b].astype(U64) << lane)
    later = np.repeat(word_of_group[1:], size) - own  # a member meets its own word and those after it
    later[np.repeat(size, size) == 1] = 0
    total = np.concatenate(([0], np.cumsum(later)))
    a = 0
    while a < n:
        z = max(int(np.searchsorted(total, total[a] + JOBS, "right")) - 1, a + 1)
        count = later[a:z]
        query = np.repeat(np.arange(a, z), count)
        word = own[query] + np.arange(len(query)) - np.repeat(total[a:z] - total[a], count)
        for at in range(0, len(query), JOBS):
            yield from compare(fp, lane, own, member, planes, query[at : at + JOBS], word[at : at + JOBS], radius)
        a = z


def compare(fp, lane, own, member, planes, query, word, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    everyone = ~U64(0)
    lanes = (member >= 0) @ (U64(1) << np.arange(64, dtype=U64))
    over = ~lanes[word]  # lanes without a member, and in the member's own word those up to itself
    same = own[query] == word
    over[same] |= (((U64(1) << lane[query[same]]) - U64(1)) << U64(1)) | U64(1)
    depth = radius.bit_length() + 1
    counters = [np.zeros(len(query), U64) for _ in range(depth)]
    spare = (1 << (depth - 1)) - 1 - radius  # counters start here, so the top one means "over"
    for i in range(depth - 1):
        if spare >> i & 1:
            counters[i][:] = everyone
    asked = fp[query]
    for b in range(64):
        carry = planes[b][word] ^ (U64(0) - ((asked >> U64(b)) & U64(1)))
        for c in counters[:-1]:
            c ^= carry
            carry &= ~c
        over |= carry
        if b % 8 == 7:
            live = over != everyone
            if not live.any():
                return
            if not live.all():
                query, word, over, asked = query[live], word[live], over[live], asked[live]
                counters = [c[live] for c in counters]
    near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    job, at = np.nonzero(near)
    if len(job):
        yield query[job], member[word[job], at]


class Forest:
    """Union-find over small arrays; keeps the least index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def key_links(fp: np.ndarray, group: np.ndarray, radius: int, free: list[int] | None = None) -> np.ndarray:
    """Links (index pairs) that connect what lies within the radius in each group: a forest."""
    size = np.diff(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))))
    forest, links = Forest(len(fp)), []
    large = np.repeat(size > KEY_MEMBERS, size)
    for i, j in within(fp[~large], group[~large], radius):
        at = np.flatnonzero(~large)
        for a, b in zip(at[i].tolist(), at[j].tolist(), strict=True):
            if forest.join(a, b):
                links.append((a, b))
    for g in np.unique(group[large]):
        at = np.flatnonzero(group == g)
        differs = int(np.bitwise_or.reduce(fp[at] ^ fp[at[0]]))
        bits = [b for b in range(64) if differs >> b & 1]
        parts = min(len(bits), 2 * radius + 2)
        if parts <= radius + 1:  # so few bits that almost every member lies within the radius
            order = at
            for i, j in within(fp[order], np.zeros(len(order), np.int64), radius):
                links += [(a, b) for a, b in zip(order[i].tolist(), order[j].tolist(), strict=True) if forest.join(a, b)]
            continue
        cut = [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]
        for out in itertools.combinations(range(parts), radius):
            mask = U64(sum(1 << b for i, c in enumerate(cut) if i not in out for b in c))
            order = at[np.argsort(fp[at] & mask, kind="stable")]
            for a, b in key_links(fp[order], fp[order] & mask, radius).tolist():
                if forest.join(int(order[a]), int(order[b])):
                    links.append((int(order[a]), int(order[b])))
    return np.array(links, np.int64).reshape(-1, 2)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole groups (rows that agree on the first `keys` columns) out of sorted batches;
    groups of one row are left out. Adds the column `group`, numbers from 0."""
    held: list[pa.RecordBatch] = []
    size = 0
    key_of = lambda b, i: [c[i].as_py() for c in b.columns[:keys]]
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < rows or key_of(held[0], 0) == key_of(batch, -1):  # nothing to cut off yet
                continue
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = np.stack([c.to_numpy() for c in t.columns[:keys]], 1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        cut = len(t) if batch is None else int(edge[-1]) if len(edge) else 0
        held = t.slice(cut).to_batches()
        size = len(t) - cut
        group = np.concatenate(([0], np.cumsum((key[1:cut] != key[: cut - 1]).any(1)))) if cut else np.zeros(0, np.int64)
        many = np.bincount(group)[group] > 1 if cut else np.zeros(0, bool)
        if many.any():
            yield t.slice(0, cut).append_column("group", pa.array(group.astype(np.int64))).filter(pa.array(many))


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within the radius."""
    masks = block_masks(blocks, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("side"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select(F.col("k.side").alias("side"), F.col("k.bits").alias("bits"), "fp")
    dealt = dealt.repartition("side", "bits").sortWithinPartitions("side", "bits", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            fp = t["fp"].to_numpy()
            links = key_links(fp.view(U64), t["group"].to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[links[:, 0]]), pa.array(fp[links[:, 1]])], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long").distinct()


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """node, root (the least node of its component) for all linked nodes but the roots.

    Alternating large-star and small-star steps: each is one pre-aggregated shuffle by node, and
    the number of rounds grows with the logarithm of the component's size. Each round is written
    to the shared folder, and only a count comes to the driver."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    before = None
    while True:
        # large star: each node hands its larger neighbours to its least neighbour
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node hands its smaller neighbours to the least of them
        large = materialise(large, label)
        older = edges
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialise(small, label)
        discard(older, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now


def named(prints: DataFrame, links: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id: the least doc_id that its node's links reach, and
    root: a name of the component that no other has."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(names, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: the least doc_id reachable over links within the radius."""
    prints = materialise(fingerprints(docs, shingle_words), "fingerprints")
    links = near_links(prints.select("fp").distinct(), radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return named(prints, links).select("doc_id", hexed, "component_id")


# Links by similarity. At a similarity of 0.8 fingerprints differ in about ten bits, beyond what
# block keys can find; there, blocks are bands of least shingle hashes, the bit-sliced comparison
# runs with a wide radius, and a sketch of the shingle set confirms what is left.

SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Bands of least hashes: two sets of similarity 0.8 share one of 20 bands of 4 with p = 0.99997.
BANDS, BAND_ROWS = 20, 4
#: One-permutation bins of the sketch, a byte each (0: no shingle).
BINS = 128
#: Standard errors around the asked similarity within which an estimate leaves the pair open, to be
#: counted exactly.
SLACK = 5.0
#: Rounds in which a spanning forest of the open pairs is counted; then all that are still apart are,
#: where they meet.
FOREST_ROUNDS = 2
#: Members of one band key that meet in one task; larger ones are dealt out in pairs of tiles.
TILE = 8192
#: Bytes of shingle sets of one band key that meet in one task at most, twice.
TILE_BYTES = 32 << 20


def wide_radius(similarity: float) -> int:
    """Differing bits that sets of this similarity stay below: the mean and seven deviations, so that
    the comparison leaves work out but no pair at the bar."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * share + 7 * np.sqrt(64 * share * (1 - share)))


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The bins' least hashes as bytes, and the band keys."""
    bins = np.full(BINS, ~U64(0))
    np.minimum.at(bins, (hashes >> U64(57)).astype(np.int64), hashes << U64(7))
    out = np.where(bins == ~U64(0), 0, mix(bins) % U64(255) + U64(1)).astype(np.uint8)
    rows = np.full(BANDS * BAND_ROWS, ~U64(0))
    seeds = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        for i, odd in enumerate(seeds):
            rows[i] = min(rows[i], ((part ^ (part >> U64(32))) * odd).min())
    keys = mix(rows).reshape(BANDS, BAND_ROWS)
    total = np.zeros(BANDS, U64)
    for j, p in enumerate(powers(0xA24BAED4963EE407, BAND_ROWS + 1)[1:]):
        total += keys[:, j] * p
    return out.tobytes(), mix(total).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle_words: int = SIMILAR_WORDS) -> DataFrame:
    """doc_id; text_hash; fp, here a hash of the document's words; bits, the fingerprint of the shingle
    set (repeats would move it away from sets that are alike); sketch and keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches):
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = np.unique(shingle_hashes(text or b"", shingle_words))
                own = xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED)
                rows.append((signed(own), signed(fingerprint(hashes)), *sketch(hashes)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "text_hash", "fp", "bits", "sketch", "keys"])

    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(work, "doc_id long, text_hash long, fp long, bits long, sketch binary, keys array<long>")


def dealt_pairs(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """side, key, t, u and the nodes' own columns: the members of each key of `tiles`, once for each pair
    of tiles that they belong to, in groups by key and pair of tiles."""
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(i, own).alias("t"), F.greatest(i, own).alias("u")))
    dealt = nodes.select("fp", F.posexplode("keys").alias("side", "key")).join(tiles, (F.col("side") == F.col("h_side")) & (F.col("key") == F.col("h_key")))
    return dealt.select("side", "key", F.explode(pairs).alias("p"), "fp").select("side", "key", "p.t", "p.u", "fp")


def in_groups(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("side", "key", "t", "u").sortWithinPartitions("side", "key", "t", "u", "bits", "fp")


def mixed_keys(nodes: DataFrame) -> DataFrame:
    """h_side, h_key, tiles: the keys whose members have different roots."""
    dealt = nodes.select("fp", "root", F.posexplode("keys").alias("side", "key"))
    mixed = dealt.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return materialise(mixed.select(F.col("side").alias("h_side"), F.col("key").alias("h_key"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "mixed_keys")


def rooted_forest(roots: np.ndarray) -> Forest:
    """A forest in which members of the same root are joined."""
    forest = Forest(len(roots))
    _, first, of = np.unique(roots, return_index=True, return_inverse=True)
    for x, y in enumerate(first[of].tolist()):
        forest.join(x, y)
    return forest


def apart(forest: Forest, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the forest does not connect."""
    roots = np.fromiter(map(forest.root, np.concatenate([i, j]).tolist()), np.int64, 2 * len(i))
    far = roots[: len(i)] != roots[len(i) :]
    return i[far], j[far]


def marks_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)


def similar_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """nodes: fp, root (what confirmed links reach from it), bits, sketch, keys (distinct). Links
    (a, b, sure) between nodes of different roots: a forest of those that are sure by their sketches,
    and of the open pairs between its trees another forest."""
    dealt = dealt_pairs(nodes, mixed_keys(nodes)).join(nodes.select("fp", "root", "bits", "sketch"), "fp")
    dealt = in_groups(dealt.select("side", "key", "t", "u", "fp", "root", "bits", "sketch"))
    radius = wide_radius(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fp: np.ndarray, pairs: list[tuple[int, int]], sure: bool) -> pa.RecordBatch:
            ends = fp[np.array(pairs, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1)), pa.array(np.full(len(ends), sure))], names=["a", "b", "sure"])

        for t in whole_groups(batches, 4):
            fp, marks, roots, links = t["fp"].to_numpy(), marks_of(t), t["root"].to_numpy(), []
            forest, maybe = rooted_forest(roots), rooted_forest(roots)  # maybe: with the open pairs
            for i, j in within(t["bits"].to_numpy().view(U64), t["group"].to_numpy(), radius):
                for at in range(0, len(i), 4096):
                    a, b = apart(maybe, i[at : at + 4096], j[at : at + 4096])  # what is connected needs no further link
                    low, high = alike(marks[a], marks[b], similarity)
                    for x, y in zip(a[low].tolist(), b[low].tolist(), strict=True):
                        maybe.join(x, y)
                        if forest.join(x, y):
                            links.append((x, y))
                    if found := [(x, y) for x, y in zip(a[high & ~low].tolist(), b[high & ~low].tolist(), strict=True) if maybe.join(x, y)]:
                        yield out(fp, found, False)
            yield out(fp, links, True)

    return dealt.mapInArrow(work, "a long, b long, sure boolean").distinct()


def open_pairs(t: pa.Table, forest: Forest, marks: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of groups (with bits, keys, side) that the forest does not connect when they are
    reached, that may have the similarity, and whether their sketches are sure of it. Each pair has
    one key that it is judged at: the first that both have."""
    keys = pc.list_flatten(t["keys"]).to_numpy().reshape(-1, BANDS)
    side = t["side"].to_numpy()
    for i, j in within(t["bits"].to_numpy().view(U64), t["group"].to_numpy(), wide_radius(similarity)):
        for at in range(0, len(i), 4096):
            a, b = apart(forest, i[at : at + 4096], j[at : at + 4096])
            here = (keys[a] == keys[b]).argmax(1) == side[a]
            a, b = a[here], b[here]
            low, high = alike(marks[a], marks[b], similarity)
            yield a[high], b[high], low[high]


def last_links(nodes: DataFrame, docs: DataFrame, made: DataFrame, shingle_words: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of different roots that connect all pairs of the similarity: every
    open pair is counted where its members meet, until they are connected, so that what comes out is a
    forest for each group and never its pairs. Shingle sets go only to keys at which a node has one."""
    dealt = dealt_pairs(nodes, mixed_keys(nodes)).join(nodes.select("fp", "root", "bits", "sketch", "keys"), "fp")
    dealt = in_groups(dealt.select("side", "key", "t", "u", "fp", "root", "bits", "sketch", "keys"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4, 10_000):
            hit, forest = np.zeros(len(t), bool), rooted_forest(t["root"].to_numpy())
            for a, b, _ in open_pairs(t, forest, marks_of(t), similarity):
                hit[a] = hit[b] = True
            for batch in t.select(["side", "key", "fp"]).filter(pa.array(hit)).combine_chunks().to_batches():
                yield batch

    held = materialise(dealt.mapInArrow(members, "side int, key long, fp long").distinct(), "open_members")
    ends = held.select("fp").distinct()
    wanted = made.join(ends, "fp", "left_semi").where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    sets = materialise(shingle_sets(docs, wanted, shingle_words), "shingle_sets")
    sized = held.join(sets.select("fp", F.length("hashes").alias("size")), "fp").groupBy("side", "key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("size") / TILE_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct(F.least(i, own).alias("t"), F.greatest(i, own).alias("u")))
    again = held.join(sized.select("side", "key", tiles.alias("tiles")), ["side", "key"]).select("side", "key", F.explode(pairs).alias("p"), "fp")
    again = again.join(nodes.select("fp", "root", "bits", "sketch", "keys"), "fp").join(sets, "fp")
    again = in_groups(again.select("side", "key", "p.t", "p.u", "fp", "root", "bits", "sketch", "keys", "hashes"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4, 1000):
            fp, forest, links = t["fp"].to_numpy(), rooted_forest(t["root"].to_numpy()), []
            sets = [np.frombuffer(x.as_buffer(), U64) for x in t["hashes"]]
            for a, b, sure in open_pairs(t, forest, marks_of(t), similarity):
                for x, y, known in zip(a.tolist(), b.tolist(), sure.tolist(), strict=True):
                    if forest.root(x) != forest.root(y) and (known or as_alike(sets[x], sets[y], similarity)):
                        forest.join(x, y)
                        links.append((x, y))
            ends = fp[np.array(links, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])

    return again.mapInArrow(counted, "a long, b long").distinct()


def as_alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sketches' share of equal bins, among those that either has, reaches the asked
    similarity for sure, and whether it may."""
    used = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    error = SLACK * np.sqrt(used * similarity * (1 - similarity))
    return same - error >= similarity * used, same + error >= similarity * used


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """fp and the sorted shingle hashes of the wanted (doc_id, fp)."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("fp", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            own = [signed(xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED)) for t in texts]  # a doc_id may have several texts
            sets = [np.unique(shingle_hashes(t, shingle_words)).tobytes() if o == f else None for t, o, f in zip(texts, own, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["fp", "hashes"])

    return held.mapInArrow(work, "fp long, hashes binary").where("hashes is not null").dropDuplicates(["fp"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity, counted exactly."""
    first, second = (sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ok.append(as_alike(np.frombuffer(x, U64), np.frombuffer(y, U64), similarity))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def similar_documents(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable over links of at least the similarity."""
    return similar_groups(docs, shingle_words, similarity).select("doc_id", "component_id")


def similar_groups(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), component_id, and root, which is the same for
    rows of one component and for no others."""
    made = materialise(sketches(docs, shingle_words), "sketches")
    nodes = made.select("fp", "bits", "sketch", "keys").dropDuplicates(["fp"])
    rooted, links, asked = nodes.withColumn("root", F.col("fp")), None, None
    for _ in range(FOREST_ROUNDS):
        found = materialise(similar_links(rooted, similarity), "similar_links")
        unsure = found.groupBy("a", "b").agg(F.max("sure").alias("sure")).where("not sure").select("a", "b")
        unsure = unsure if asked is None else unsure.join(asked, ["a", "b"], "left_anti")  # what was counted stays as it was
        ends = unsure.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = made.join(ends, "fp", "left_semi").where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
        checked = materialise(confirmed(unsure, shingle_sets(docs, wanted, shingle_words), similarity), "confirmed")
        new = found.where("sure").select("a", "b").unionAll(checked)
        links, asked = (new, unsure) if links is None else (links.unionAll(new), asked.unionAll(unsure))
        if not found.limit(1).count():
            break
        roots = materialise(components(links), "roots")
        rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "bits", "sketch", "keys")
    else:
        links = links.unionAll(materialise(last_links(rooted, docs, made, shingle_words, similarity), "last_links"))
    return named(made.select("doc_id", "text_hash", "fp"), links).select("doc_id", "text_hash", "component_id", "root")
