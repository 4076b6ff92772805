"""Vectorised word hashing: every word of a batch of texts, without a Python step per word.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. Its
hash is 64 bits: a polynomial over random byte codes, mixed. Hashes of different words are taken to differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240601)
IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
CODE[~IS_WORD] = 0
BASE = int(_rng.integers(1, 2**62)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i, modulo 2 ** 64, for i < n at least."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            a = np.full(max(n, 1 << 20), U(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(texts: pa.Array, size: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of texts, of about size bytes and at most so many rows each; a longer text is a slice of its own."""
    n = len(texts)
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    a = 0
    while a < n:
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right"))
        b = min(n, max(b, a + 1), a + rows)
        yield a, texts.slice(a, b - a)
        a = b


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more for the end); nulls count as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


@dataclass
class Words:
    hash: np.ndarray  # of each word
    doc: np.ndarray  # its text's place in the batch
    first: np.ndarray  # of each text: its first word's place; one more for the end
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray
    at: np.ndarray


def spans(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are members, cut where texts begin."""
    w = member[data]
    cut = at[:-1][at[:-1] < len(w)]
    before = np.zeros(len(w) + 1, bool)  # is the byte before a member of the same text?
    before[1:] = w
    before[cut] = False
    start = np.flatnonzero(w & ~before[:-1])
    after = np.zeros(len(w) + 1, bool)
    after[:-1] = w
    after[cut] = False
    return start, np.flatnonzero(w & ~after[1:]) + 1


def words(texts: pa.Array, lower: bool = True) -> Words:
    data, at = raw(pc.utf8_lower(texts) if lower else texts)
    start, end = spans(data, at, IS_WORD)
    up, down = powers(len(data) + 1)
    if len(start):
        h = np.add.reduceat(CODE[data] * up[: len(data)], start)
        h = mix(h * down[start])
    else:
        h = np.empty(0, np.uint64)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(h, doc, first, start, end, data, at)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams, and where each text's begin (one more for the end).

    A text of fewer than n words, but one at least, has one gram of all its words.
    """
    count = np.diff(w.first)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(have, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    if len(w.hash) >= n:
        g = w.hash[: len(w.hash) - n + 1] * STEP[0]
        for k in range(1, n):
            g = g + w.hash[k : len(w.hash) - n + 1 + k] * STEP[k]
        whole = w.doc[: len(g)] == w.doc[n - 1 :]
        long = np.repeat(count >= n, have)
        out[long] = mix(g[whole])
    for i in np.flatnonzero((count > 0) & (count < n)):
        part = w.hash[w.first[i] : w.first[i + 1]]
        out[first[i]] = mix((part * STEP[: len(part)]).sum(dtype=np.uint64, keepdims=True) + U(len(part)))[0]
    return out, first


def ngram_sums(w: Words, n: int, value: np.ndarray) -> np.ndarray:
    """Of each n-gram, as ngrams gives them, the sum of value (a number of each word); 0 for texts of fewer than n words."""
    count = np.diff(w.first)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(have.sum(), np.int32)
    if len(value) >= n:
        total = value[: len(value) - n + 1].astype(np.int32)
        for k in range(1, n):
            total += value[k : len(value) - n + 1 + k]
        out[np.repeat(count >= n, have)] = total[w.doc[: len(total)] == w.doc[n - 1 :]]
    return out
