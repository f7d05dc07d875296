"""Language identification: scripts narrow the candidates, Viterbi labels the words.

A model is learned from labelled rows: for each language, hashed counts of character 1- to 4-grams
of its words, and the scripts (Unicode ranges) that its words are written in. It is fitted on at
most FIT_PER_LANGUAGE distinct texts of each language (those of least hash, so never none), and at
most 65536 counts a language come to the driver, whatever the corpus. A word's score per language is its mean n-gram
log-probability; languages never seen in the word's script are out. Viterbi over a text's words,
with a penalty for each switch, labels spans; the language with most letters is the prediction, and
its share of all letters the score.

Defined cases: null text or text without letters gives `und` and score 0; without labelled rows all
texts are `und`; a script that no language has leaves all languages as candidates; ties go to the
language that sorts first; null doc_id is not held out (its crc32 is null) and never learned from;
repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import U64, mix, powers, text_slices

BUCKETS = 1 << 16
#: The classifier is fitted on this many distinct texts of a language at most.
FIT_PER_LANGUAGE = 1_500
NGRAMS = (1, 2, 3, 4)
SWITCH_PENALTY = 3.0
#: A script belongs to a language if at least this share of its training words is written in it.
SCRIPT_SHARE = 0.01
CACHE_WORDS = 300_000
#: Bytes of text that are labelled at once: their words' n-grams take a hundred times as much.
LABEL_BYTES = 1 << 20
UND = "und"
#: First code points of script ranges, and their names.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "other"),
]
STARTS = [s for s, _ in SCRIPTS]
FIND = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
LETTER = regex.compile(r"\p{L}").search


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages) log-probabilities
    scripts: dict[str, np.ndarray]  # which languages a script leaves


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hash buckets of all n-grams of words, a space standing at either end."""
    codes = np.frombuffer(f" {' '.join(words).lower()} ".encode("utf-32-le"), np.uint32)
    space = np.flatnonzero(codes == 32)
    codes = codes.astype(U64)
    word = np.searchsorted(space, np.arange(len(codes)), "right") - 1
    ahead = np.append(space, len(codes))[word + 1] - np.arange(len(codes))  # to the next space
    of, buckets = [], []
    for n in NGRAMS:
        at = np.flatnonzero((ahead >= n - 1) & (word < len(words)) & ((codes != 32) | (n > 1)))
        at = at[at + n <= len(codes)]
        total = np.full(len(at), n, U64)
        for j, p in enumerate(powers(0x9E3779B97F4A7C15, n + 1)[1:]):
            total += codes[at + j] * p
        of.append(word[at])
        buckets.append((mix(total) >> U64(48)).astype(np.int64))
    return np.concatenate(of), np.concatenate(buckets)


def least_hash(texts: int, wanted: int) -> int:
    """The bound under which about twice as many of so many 64-bit hashes lie as are wanted."""
    return min((1 << 63) - 1, 2 * wanted * (1 << 64) // max(1, texts) - (1 << 63))


def fit_sample(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """text, lang: of each language the distinct texts of least hash, `per_language` at most. A bound
    from the (approximate) number of texts leaves out the others before anything is shuffled."""
    hashed = labelled.select("text", "lang", F.xxhash64("text").alias("hash"))
    bounds = {r["lang"]: least_hash(r["n"], per_language) for r in hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}  # a row a language
    if not bounds:
        return labelled.select("text", "lang")
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    few = hashed.where(F.col("hash") <= bound).dropDuplicates(["lang", "hash"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # over twice per_language rows or so
    return few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("text", "lang")


def learn(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model:
    """labelled: text and lang, neither null."""
    sample = fit_sample(labelled, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in text_slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if words := FIND(text):
                    held += np.bincount(ngram_buckets(words)[1], minlength=BUCKETS)
                for word in words:
                    key = (lang, script(word))
                    scripts[key] = scripts.get(key, 0) + 1
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int64)), pa.array([""] * len(at)), pa.array(held[at])], names=["lang", "bucket", "script", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scripts]), pa.array([-1] * len(scripts), pa.int64()), pa.array([k[1] for k in scripts]), pa.array(list(scripts.values()), pa.int64())], names=["lang", "bucket", "script", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, bucket long, script string, n long")
    rows = counted.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS and some a language
    languages = sorted({r["lang"] for r in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    table = np.full((BUCKETS, len(languages)), 0.5)
    scripts: dict[str, np.ndarray] = {}
    for r in rows:
        if r["bucket"] >= 0:
            table[r["bucket"], number[r["lang"]]] += r["n"]
        else:
            scripts.setdefault(r["script"], np.zeros(len(languages)))[number[r["lang"]]] = r["n"]
    written = sum(scripts.values()) if scripts else np.zeros(len(languages))
    return Model(languages, np.log(table / table.sum(0, keepdims=True)).astype(np.float32), {s: n >= SCRIPT_SHARE * np.maximum(written, 1) for s, n in scripts.items()})


class WordScores:
    """Score rows by word, kept from slice to slice up to CACHE_WORDS words."""

    def __init__(self, model: Model):
        self.model, self.place, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.place, self.rows = {}, self.rows[:0]
        if new := list({w for w in words if w not in self.place}):
            self.rows = np.concatenate([self.rows, self.made(new)])
            self.place.update(zip(new, range(len(self.place), len(self.rows)), strict=True))
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def made(self, words: list[str]) -> np.ndarray:
        word, bucket = ngram_buckets(words)
        count = np.bincount(word, minlength=len(words))
        out = np.stack([np.bincount(word, column[bucket], len(words)) for column in self.model.scores.T], 1)
        out /= np.sqrt(np.maximum(count, 1))[:, None]
        allowed = np.array([self.model.scripts.get(script(w), np.ones(len(self.model.languages), bool)) for w in words])
        out[~allowed & allowed.any(1, keepdims=True)] = out.min() - 50
        return (out - out.max(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word of each text; texts step together, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    size = sizes[order]
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # texts with more words than t
    for t, n in enumerate(live.tolist()):
        at = first[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(1)
            switch = v[np.arange(n), best] - penalty
            kept = v >= switch[:, None]
            stay[at], source[at] = kept, best
            v[:] = np.where(kept, v, switch[:, None])
        v += scores[at]
        v -= v.max(1, keepdims=True)
    label = np.zeros(len(scores), np.int64)
    now = value.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        at = first[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], source[at])
    return label


def label_texts(texts: list[str | None], cache: WordScores) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the language numbers and the letters of its words."""
    words = [FIND(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    labels = viterbi(cache.of(flat), sizes)
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return [(labels[a:b], letters[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def span_rows(texts: list[str | None], cache: WordScores) -> list[list[tuple[int, int, str]]]:
    """Per text its spans of one language: first and last word (exclusive), and language."""
    out = []
    for labels, _ in label_texts(texts, cache):
        edge = np.flatnonzero(np.diff(labels, prepend=-1, append=-1)) if len(labels) else np.zeros(0, np.int64)
        out.append([(int(a), int(b), cache.model.languages[labels[a]]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    return out


ADDED = ("lang_pred", "score", "n_spans")


def identify(docs: DataFrame, model: Model, added: list[str] | tuple[str, ...] = ADDED) -> DataFrame:
    """All columns of docs (doc_id, text and others), and the three that are added: the language, its
    share and the number of spans. Columns of docs that are named like those give way."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a column for each language
    own = docs.select(*[c for c in docs.columns if c not in added])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        cache = WordScores(model)
        for batch in text_slices(batches, size=LABEL_BYTES):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            preds, shares, spans = [], [], []
            found = label_texts(texts, cache) if model.languages else [(np.zeros(0, np.int64),) * 2] * len(texts)
            for labels, letters in found:
                per = np.bincount(labels, letters, len(model.languages)) if len(labels) else np.zeros(0)
                preds.append(model.languages[int(per.argmax())] if len(per) else UND)
                shares.append(float(per.max() / per.sum()) if len(per) else 0.0)
                spans.append(int((np.diff(labels) != 0).sum()) + 1 if len(labels) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds), pa.array(shares, pa.float64()), pa.array(spans, pa.int64())], names=[*batch.schema.names, *added])

    fields = [T.StructField(name, kind) for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.LongType()), strict=True)]
    return own.mapInArrow(work, T.StructType([*own.schema.fields, *fields]))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter, by the same words that identify() labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([bool(t and LETTER(t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def learn_rows(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out()).select("text", "lang")


def report(docs: DataFrame) -> DataFrame:
    model = learn(learn_rows(docs))
    own = docs.select("doc_id", "text")
    return identify(own, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
