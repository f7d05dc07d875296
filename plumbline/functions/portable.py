"""Draws that do not depend on partitioning, worker or engine: hashes of named keys.

Every random choice (split, sample, shuffle, resample) is an order or an index made from md5 over
seed and key, so a result can be repeated anywhere and checked by an independent SQL engine.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of md5 that make a non-negative 60-bit integer.
DIGITS = 15


def key_hash(*parts: Column | str | int) -> Column:
    """A 60-bit integer from the parts, joined by `|`."""
    cols = [p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def draw(n: Column | int, *parts: Column | str | int) -> Column:
    """An index in [0, n)."""
    return F.pmod(key_hash(*parts), n if isinstance(n, Column) else F.lit(n))


def sql_hash(*parts: str) -> str:
    """The SQL of key_hash over SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {DIGITS}) AS BIGINT)"


#: md5's constants and rotations, and the numbers that are hashed at once (their arrays stay in cache).
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
AT_ONCE, BLOCK = 1 << 14, 64


def md5_head(words: list, n: int) -> np.ndarray:
    """The first DIGITS hex digits of md5 as a number, of n messages of one block: 16 words each, an int
    where all messages have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        fixed = isinstance(words[g], int)
        f += a
        f += np.uint32((SINES[i] + (words[g] if fixed else 0)) & 0xFFFFFFFF)
        if not fixed:
            f += words[g]
        turned = f << np.uint32(TURNS[i])
        turned |= f >> np.uint32(32 - TURNS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4)).astype(np.uint64)


def number_hashes(prefixes: list[str], numbers: np.ndarray) -> np.ndarray:
    """key_hash() of each prefix (the parts before, joined by `|`) and each number: a row for each prefix.
    The digits of a number are found once, and many messages go through md5 together."""
    heads = [f"{p}|".encode() for p in prefixes]
    if max(map(len, heads), default=0) + 21 > BLOCK - 8:  # more than one block
        return np.array([[int(hashlib.md5(h + b"%d" % x).hexdigest()[:DIGITS], 16) for x in numbers.tolist()] for h in heads], np.uint64).reshape(len(heads), len(numbers))
    out = np.empty((len(heads), len(numbers)), np.uint64)
    for lo in range(0, len(numbers), AT_ONCE):
        part = numbers[lo : lo + AT_ONCE]
        size = np.where(part < 0, part.astype(np.uint64) * np.uint64(2**64 - 1), part.astype(np.uint64))
        length = np.searchsorted(np.array([10**k for k in range(1, 20)], np.uint64), size, "right") + 1
        kind = np.where(part < 0, -length, length)
        for k in np.unique(kind).tolist():
            at, digits = np.flatnonzero(kind == k), []
            rest = size[at].astype(np.uint32) if abs(k) < 10 else size[at]
            for _ in range(abs(k)):
                left = rest // rest.dtype.type(10)
                digits.append((rest - left * rest.dtype.type(10)).astype(np.uint32) + np.uint32(48))
                rest = left
            for i, head in enumerate(heads):
                fixed = head + b"-" * (k < 0)
                end = len(fixed) + len(digits)
                words: list = list(struct.unpack("<16I", (fixed + bytes(len(digits)) + b"\x80").ljust(BLOCK - 8, b"\0") + struct.pack("<Q", 8 * end)))
                for j, digit in enumerate(reversed(digits), len(fixed)):
                    word, moved = words[j // 4], digit << np.uint32(8 * (j % 4))
                    words[j // 4] = moved | (np.uint32(word) if isinstance(word, int) else word)
                out[i, lo + at] = md5_head(words, len(at))
    return out
