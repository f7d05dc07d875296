"""Byte-level BPE over whole slices of texts.

The pre-tokens of all texts of a slice are found at once: each code point has one of four classes
(letter, number, white space, other), and where a pre-token begins follows from its neighbours. Each
pre-token is looked up by a 64-bit hash in a table of those met before and compared with what the
table holds, code point by code point; only new ones go to the tokenizer's merges. Byte-level BPE
never merges across pre-tokens, so ids and offsets are those of the whole text.

Control strings (special tokens) stand alone: the text before and after one is split as if the text
ended and began there. Offsets are code points; a token of part of a character has all of it.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex

from plumbline.llm.common import U64, mix, powers

LETTER, NUMBER, SPACE, OTHER = range(4)
#: The pre-token pattern that `begins` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points of pre-tokens that a worker keeps; beyond it the table starts anew.
TABLE_CODES = 4 << 20
SLOTS = 1 << 19
#: Bytes of text that are encoded at once (a longer text makes a slice of its own).
SLICE_BYTES = 1 << 20


class Encoded(NamedTuple):
    ids: np.ndarray  # of all texts, in order
    ends: np.ndarray  # ids up to each text, from 0
    start: np.ndarray  # code points in the joined text
    stop: np.ndarray
    text_ends: np.ndarray  # code points up to each text, from 0


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for their own byte, the others are
    numbered on from 256 in byte order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255) or b == 173]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def code_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def begins(codes: np.ndarray, kind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where the pre-tokens begin. fresh: where a text (or what follows a control string) begins."""
    n = len(codes)
    first = fresh.copy()
    first[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    after = np.zeros(n, bool)  # the last white space before something: it stands alone or joins it
    after[:-1] = white[:-1] & ~white[1:] & ~fresh[1:]
    joined = np.zeros(n, bool)
    joined[1:] = after[:-1] & (codes[:-1] == 32)
    first = (first & ~joined) | after
    quotes = np.flatnonzero((codes == 39) & first)
    for ending in ENDINGS:
        k = len(ending)
        at = quotes[quotes + k < n]
        fits = np.ones(len(at), bool)
        for j, c in enumerate(ending, 1):
            fits &= (codes[at + j] == ord(c)) & ~fresh[at + j]
        at = at[fits]
        first[at + 1] = False
        rest = at[at + k + 1 < n] + k + 1
        first[rest[kind[rest] == LETTER]] = True
    return first


def merger(tokenizer, model: dict):
    """A function from a pre-token's bytes to its ids. Where the ids of merged tokens follow the order
    of the merges, ids are ranks, and tiktoken's loop over ranks gives the tokenizer's own ids."""
    letters = byte_letters()
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = len(vocabulary) - len(merges)
    if all(vocabulary.get(a + b) == first + k for k, (a, b) in enumerate(merges)):
        import tiktoken

        byte_of = {letters.get(b, chr(b)): b for b in range(256)}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda raw: [t.id for t in tokenizer.model.tokenize(raw.decode("latin-1").translate(letters))]


class Encoder:
    """Ids and offsets of texts, with a table of the pre-tokens met before."""

    def __init__(self, path: str, controls: tuple[str, ...] = ()):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens(list(controls))
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.controls = {c: tokenizer.token_to_id(c) for c in [*(x["content"] for x in held.get("added_tokens", [])), *controls]}
        self.find = regex.compile("|".join(map(regex.escape, sorted(self.controls, key=len, reverse=True))) or r"(?!)").finditer
        self.merge = merger(tokenizer, held["model"])
        self.width = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of an id
        for token, i in held["model"]["vocab"].items():
            self.width[i] = len(token)
        for c, i in self.controls.items():
            self.width[i] = len(c.encode())
        self.kinds = code_classes()
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.slot = np.full(SLOTS, -1, np.int64)
        self.hash, self.size = np.zeros(0, U64), np.zeros(0, np.int64)
        self.code_at, self.id_at, self.id_count = (np.zeros(0, np.int64) for _ in range(3))
        self.codes, self.ids, self.start, self.stop = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, words: list[str], hashes: list[int]) -> None:
        raw = [w.encode() for w in words]
        found = [[self.controls[w]] if w in self.controls else self.merge(r) for w, r in zip(words, raw, strict=True)]
        self.number.update(zip(hashes, range(len(self.size), len(self.size) + len(words)), strict=True))
        sizes, counts = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, found), np.int64, len(words))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum()))
        data = np.frombuffer(b"".join(raw), np.uint8)
        code_of = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point that a byte is part of
        end = np.cumsum(self.width[ids])
        before = np.repeat(np.cumsum(sizes) - sizes, counts)
        self.code_at = np.concatenate([self.code_at, len(self.codes) + np.cumsum(sizes) - sizes])
        self.id_at = np.concatenate([self.id_at, len(self.ids) + np.cumsum(counts) - counts])
        self.id_count = np.concatenate([self.id_count, counts])
        self.size = np.concatenate([self.size, sizes])
        self.hash = np.concatenate([self.hash, np.array(hashes, U64)])
        self.codes = np.concatenate([self.codes, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.start = np.concatenate([self.start, (code_of[end - self.width[ids]] - before).astype(np.int32)])
        self.stop = np.concatenate([self.stop, (code_of[end - 1] + 1 - before).astype(np.int32)])

    def lookup(self, flat: str, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each pre-token's number in the table."""
        if len(self.codes) > TABLE_CODES:
            self.clear()
        slots = (hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.slot[slots]
        known = out >= 0
        known[known] = self.hash[out[known]] == hashes[known]
        if not known.all():
            left = np.flatnonzero(~known)
            keys, example, of = np.unique(hashes[left], return_index=True, return_inverse=True)
            example = left[example]
            new = [(k, i) for k, i in zip(keys.tolist(), example.tolist(), strict=True) if k not in self.number]
            if new:
                self.learn([flat[first[i] : first[i] + sizes[i]] for _, i in new], [k for k, _ in new])
            numbers = np.fromiter(map(self.number.__getitem__, keys.tolist()), np.int64, len(keys))
            out[left] = numbers[of]
            self.slot[slots[example]] = numbers
        return out

    def encode(self, texts: list[str]) -> Encoded:
        flat = "".join(texts)
        text_ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        n = len(codes)
        if not n:
            none = np.zeros(0, np.int64)
            return Encoded(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), none, none, text_ends)
        fresh = np.zeros(n, bool)
        fresh[text_ends[text_ends < n]] = True
        alone = []
        if any(c in flat for c in self.controls):
            for k in [k for k, t in enumerate(texts) if any(c in t for c in self.controls)]:
                alone += [(int(text_ends[k]) + m.start(), int(text_ends[k]) + m.end()) for m in self.find(texts[k])]
            edges = np.array(alone).ravel()
            fresh[edges[edges < n]] = True
        start = begins(codes, self.kinds[codes], fresh)
        if alone:
            a, b = np.array(alone).T
            inner = np.repeat(a + 1 - np.concatenate(([0], np.cumsum(b - a - 1)[:-1])), b - a - 1) + np.arange(int((b - a - 1).sum()))
            start[inner] = False
        first = np.flatnonzero(start)
        sizes = np.diff(first, append=n)
        place = np.arange(n) - np.repeat(first, sizes)
        hashes = mix(np.add.reduceat((codes + np.uint32(1)) * powers(0x9E3779B97F4A7C15, int(sizes.max()))[place], first) + sizes.astype(U64))
        number = self.lookup(flat, codes, first, sizes, hashes)
        same = self.size[number] == sizes
        held = np.minimum(np.repeat(self.code_at[number], sizes) + place, len(self.codes) - 1)
        same &= np.logical_and.reduceat(self.codes[held] == codes, first)
        if not same.all():  # two pre-tokens of one hash: the later one is looked up under another
            number = number.copy()
            for i in np.flatnonzero(~same).tolist():
                word = flat[first[i] : first[i] + sizes[i]]
                if word not in self.number:
                    self.learn([word], [0])
                    self.number[word] = len(self.size) - 1
                number[i] = self.number[word]
        counts = self.id_count[number]
        upto = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(self.id_at[number] - upto[:-1], counts) + np.arange(int(upto[-1]))
        begin = np.repeat(first, counts)
        return Encoded(self.ids[at], upto[np.searchsorted(first, text_ends)], begin + self.start[at], begin + self.stop[at], text_ends)


@lru_cache(2)
def encoder(path: str | None = None, controls: tuple[str, ...] = ()) -> Encoder:
    """The worker's encoder; it stays from task to task."""
    import public_tokenizers as P

    return Encoder(path or P.path("byte_bpe_50k.json"), controls)
