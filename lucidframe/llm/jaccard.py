"""N-gram Jaccard join by parity sketches: which documents have sets of word n-grams with Jaccard >= t, and their classes.

Sketch. Every n-gram g of a set toggles a parity bit; the bits lie in blocks (2**BLOCK_BITS of them for each of LEVELS levels of how frequent
n-grams are in the corpus, the rarest first), and a block of 2**64 virtual bits is kept as the XOR of its set bits' codes. Only non-empty blocks
are materialised. An n-gram that only one of two sets has changes one block, so the blocks that differ bound the symmetric difference
from below, and split by side: a block of a that differs from b's holds one of a's own n-grams or was hit by one of b's.

Pigeonhole. J >= t leaves a at most A = (|a| - t |b|) / (1 + t) n-grams that b lacks, and b at most B, likewise; A <= (1 - t) |a| for every
partner. Each set emits its non-empty blocks in one order for all sets until it has p = (1 - t) s + s / 16 + X + 1 of them
or all, X bounding the blocks of one set that the other's n-grams hit (more are less likely than 1e-11). Whichever of two similar sets stops
first has at most A + X (or B + X) blocks that differ, so they share min(p_a - A, p_b - B) - X emitted blocks at least; pairs that share
fewer are no candidates.

Size bands. A block's sets are ordered by size and a set meets only those of its band, from its own size to 1 / t times that.

Order. Levels rise with the number of sets expected to hold an n-gram: the product of its words' shares (of every SAMPLED-th piece of the texts) times all
n-grams, so that those with a rare word come first, however many documents there are; of n-grams that are counted often over all documents, at
least their count, so that passages which many documents share make no candidates while rarer n-grams do. The order changes cost only.

Candidates. A block of up to SMALL sets gives its pairs, whose shared blocks are counted. A block of more gives a star: each set with the block's first set,
so that a large group costs rows in proportion to its sets. Stars whose centres are candidates of each other are merged, and all pairs within
a merged star are candidates. Of each set the stars that hold the fewest of its blocks are left out, as long as all their blocks are
fewer than E s / (1 + t) - 2 (E = 1 / 16); the count that a pair's small blocks must reach is less by as many as its sets leave out, so that none is lost. A block that more than HOT sets hold is dealt to cells, of which each two meet in a task of their own.

Verification is exact: the candidates of a neighbourhood, or the sets of a star, are brought together in buckets of bounded numbers and sizes, two buckets at
a time, and their n-grams intersected. A pair that meets in several stars counts in the first. A bucket pair gives sums of links and a local
forest, never its pairs. No pair or partner is capped.

Sets that are equal are one class from the start (thousands of copies cost no pairs); the class is known by 116 bits.

Result of jaccard_join: a row for each document: doc_id, class_id, links. Documents are linked if any of their sets have J >= t; class_id is the least
id among all documents reached over links, links the number of other documents linked directly (exact copies included).
Result of jaccard_pairs: doc_a, doc_b, jaccard of the linked classes of equal sets, each by its least id.

Defined results: rows of null id are left out; a null text, or one without a word, has no n-grams, no links and its own id as class; a text of fewer
than n words has one n-gram, all its words; rows that repeat an id with equal sets count once, with different sets the links of each add
up and its classes join where it is their least id; ties (equal Jaccard, equal sizes) don't matter, as nothing is ranked; texts of any length count whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidframe.llm.common import c, components, ensure_checkpoint_dir, ensure_workers, fresh, release
from lucidframe.llm.tokens import U, mix, ngram_sums, ngrams, pieces, words

N = 3
THRESHOLD = 0.5
BLOCK_BITS = 40
BROADCAST_MB = 32  # candidate members up to this size are broadcast to the documents; beyond, both are shuffled
LEVEL_BITS = 4  # low bits of an n-gram's hash that give way to its level
LEVELS = 2**LEVEL_BITS
SLOT_BITS = 22  # high bits of a word's hash that tell its share, in a table of 4 MB
WORDS = 100_000  # most frequent words whose shares are known; the others count as the rarest of them
SAMPLED = 16  # of so many pieces of the texts the words of one are counted
FREQUENT = 1_000_000  # n-grams whose counts are known, 8 MB of them
CHUNK = 4_000_000  # n-grams counted at a time
OFTEN = 2  # sets of a chunk that an n-gram must occur in to be counted
SMALL = 16  # sets of a block up to which it gives pairs
HOT = 1_000_000  # sets of a cell of a frequent n-gram
TASK_ROWS = 1_000_000  # emitted blocks of a task
BUCKET, BUCKET_GRAMS = 1000, 1_000_000  # sets and n-grams of a bucket that verification loads
EXTRA = 16  # a set emits one n-gram of so many more than it must
CODES = 64  # size classes of a doubling
PART = 44  # low bits of a key, of content
EPS = 1e-9


def emitted(s: np.ndarray, t: float) -> np.ndarray:
    """p: blocks that sets of sizes s emit; x of them may be hit by n-grams of a partner, or by others of the set itself."""
    mean = s.astype(float) ** 2 / t / 2**BLOCK_BITS
    x = np.where(s <= 64, 1, np.ceil(mean + 10 * np.sqrt(mean)) + 2)
    return np.minimum(s, np.floor((1 - t) * s + EPS) + s // EXTRA + x + 1).astype(np.int64)


def bounds(fp: Column) -> tuple[Column, Column]:
    """Least and largest size of a set, by its fingerprint."""
    code = F.shiftright(fp, 52).cast("double")
    low, high = (F.ceil(F.pow(F.lit(2.0), (code + k) / CODES) - 1e-6).cast("double") for k in (0, 1))
    return low, F.greatest(low, high - 1)


def spare(fp: Column, t: float) -> Column:
    """Blocks of a set that may go unseen."""
    low = bounds(fp)[0]
    return F.when(low <= 32, 0.0).otherwise(F.greatest(low / (EXTRA * (1 + t)) - 2, F.lit(0.0)))


def enough(a: Column, b: Column, shared: Column, t: float) -> Column:
    """Whether two sets, known by fingerprints, share as many emitted blocks as similar ones must."""

    def least(low: Column, high: Column) -> Column:
        mean = high * high / (t * 2**BLOCK_BITS)
        x = F.when(high <= 64, 1.0).otherwise(F.ceil(mean + 10 * F.sqrt(mean)) + 2.0)
        return F.least(F.floor((1 - t) * low + EPS) + F.floor(low / EXTRA) + 1.0, low - 2 * x)

    (la, ha), (lb, hb) = bounds(a), bounds(b)
    need = F.least(least(la, ha) - (ha - t * lb) / (1 + t), least(lb, hb) - (hb - t * la) / (1 + t))
    return (shared >= need - EPS) & (F.least(ha, hb) >= t * F.greatest(la, lb) - EPS)


def distinct_sets(texts: pa.Array, n: int, frequent: Frequent | None = None, heard: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and where each text's begin (one more for the end).

    With frequent, their low bits are their levels by words. heard: gets the hashes of all words.
    """
    w = words(texts)
    if heard is not None:
        heard.append(w.hash)
    g, first = ngrams(w, n)
    if frequent is not None and frequent.shares is not None:
        g = (g & ~U(LEVELS - 1)) | frequent.steps[ngram_sums(w, n, frequent.shares[w.hash >> U(64 - SLOT_BITS)])]
    for i in np.flatnonzero(np.diff(first) > 1):
        g[first[i] : first[i + 1]].sort()
    new = np.ones(len(g), bool)
    if len(g):
        new[1:] = g[1:] != g[:-1]
        new[first[:-1][np.diff(first) > 0]] = True
    return g[new], np.concatenate(([0], np.cumsum(new)))[first]


def size_code(s: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(s) * CODES + EPS).astype(np.uint64)


def prints(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of every non-empty set; the first has the set's size class in its high bits."""
    sizes = np.diff(at)
    at, sizes = at[:-1][sizes > 0], sizes[sizes > 0]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = g & ~U(LEVELS - 1)
    fp = (size_code(sizes) << U(52)) | (np.add.reduceat(mix(g + U(1)), at) >> U(12))
    return fp.view(np.int64), np.add.reduceat(mix(g ^ U(0x9E3779B97F4A7C15)), at).view(np.int64)


def level(sets: np.ndarray) -> np.ndarray:
    """Level of n-grams that so many sets are expected to hold: from 2**-12 on in steps of 1.6 doublings."""
    return np.clip(np.floor((np.log2(np.maximum(sets, 1e-300)) + 12) / 1.6) + 1, 0, LEVELS - 1).astype(np.uint64)


class Frequent:
    """Sorted hashes of the frequent n-grams with their levels; of those that more than HOT sets hold, into how many cells the sets are dealt; words' shares.

    shares: by the high bits of a word's hash, how many eighths of a doubling its share is above that of a rare one; steps: level of an n-gram by the sum of its words'.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None, heard: np.ndarray | None = None, total: int = 0, n: int = N):
        grams = grams & ~U(LEVELS - 1)
        order = np.argsort(grams)
        self.grams, cells = grams[order], -(-counts[order] // HOT)
        self.levels = level(counts[order])
        self.hot, self.cells = self.grams[cells > 1], cells[cells > 1]
        self.near = np.zeros(1 << 23, np.uint8)  # bits: whether any begins with these 26 bits
        h = self.grams >> U(38)
        np.bitwise_or.at(self.near, (h >> U(3)).astype(np.int64), (U(1) << (h & U(7))).astype(np.uint8))
        self.shares = self.steps = None
        if words is not None and len(words):
            rarest = heard.min() if len(words) >= WORDS else 1
            self.shares = np.zeros(1 << SLOT_BITS, np.uint8)
            np.maximum.at(self.shares, (words >> U(64 - SLOT_BITS)).astype(np.int64), np.minimum(255, np.round(8 * np.log2(heard / rarest))).astype(np.uint8))
            self.steps = level(total * (rarest / heard.sum()) ** n * 2.0 ** (np.arange(255 * n + 1) / 8))

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in g of frequent n-grams, their cells and levels."""
        h = g >> U(38)
        at = np.flatnonzero((self.near[(h >> U(3)).astype(np.int64)] >> (h & U(7)).astype(np.uint8)) & 1)
        if not len(at):
            return at, at, at.astype(np.uint64)
        own = g[at] & ~U(LEVELS - 1)
        where = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        met = self.grams[where] == own
        at, own, levels = at[met], own[met], self.levels[where[met]]
        cells = np.ones(len(at), np.int64)
        if len(self.hot):
            where = np.minimum(np.searchsorted(self.hot, own), len(self.hot) - 1)
            cells[self.hot[where] == own] = self.cells[where][self.hot[where] == own]
        return at, cells, levels


def block_keys(g: np.ndarray, at: np.ndarray, fp: np.ndarray, t: float, frequent: Frequent | None, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) of the blocks that non-empty sets emit: the task in the high bits, then content."""
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rise, cells = g & U(LEVELS - 1), None
    if frequent is not None and len(frequent.grams):
        where, r, levels = frequent.find(g)
        if len(where):
            rise[where] = np.maximum(rise[where], levels)
            cells = np.ones(len(g), np.int64)
            cells[where] = r
    order = np.argsort(((doc << LEVEL_BITS) | rise.astype(np.int64)).astype(np.uint16 if len(sizes) <= 1 << (16 - LEVEL_BITS) else np.int64), kind="stable")
    g, rise, cells = g[order], rise[order], None if cells is None else cells[order]
    block = (g >> U(64 - BLOCK_BITS)) | (rise << U(BLOCK_BITS))
    new = np.ones(len(g), bool)
    new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    rank = np.cumsum(new)
    keep = rank - rank[at[doc]] < emitted(sizes, t)[doc]
    g, block, doc, new = g[keep], block[keep], doc[keep], new[keep]
    starts = np.flatnonzero(new)
    h = mix(np.bitwise_xor.reduceat(mix(g), starts) ^ mix(block[starts] + U(1)))
    fp = fp[doc[starts]]
    if cells is not None and (r := np.maximum.reduceat(cells[keep], starts)).max() > 1:
        one = r == 1
        hot, rh, fh = h[~one], r[~one], fp[~one]
        reps = np.repeat(np.arange(len(hot)), rh)
        v = np.arange(len(reps)) - np.repeat(np.cumsum(rh) - rh, rh)
        u = (mix(fh.view(np.uint64)) % rh.astype(np.uint64)).astype(np.int64)[reps]
        lo, hi = np.minimum(u, v).astype(np.uint64), np.maximum(u, v).astype(np.uint64)
        met = u != v
        h = np.concatenate((h[one], mix(hot[reps] + lo * U(0x9E3779B97F4A7C15) + hi * U(0xC2B2AE3D27D4EB4F) + U(1))[met]))
        fp = np.concatenate((fp[one], fh[reps][met]))
    part = ((h >> U(32)) * U(parts)) >> U(32)
    return ((part << U(PART)) | (mix(h) >> U(64 - PART))).view(np.int64), fp


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc, fp, fp2, size of every document; fp and fp2 are null where it has no n-gram. docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in pieces(batch.column(1)):
                g, at = distinct_sets(part, n)
                size = np.diff(at)
                some = size > 0
                out = [np.zeros(len(part), np.int64) for _ in range(2)]
                for x, y in zip(out, prints(g, at)):
                    x[some] = y
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), *(pa.array(x, mask=~some) for x in out), pa.array(size, pa.int64())], ["doc", "fp", "fp2", "size"])
        release()

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, fp long, fp2 long, size long")


def different_sets(batches: Iterator[pa.RecordBatch], n: int, frequent: Frequent | None = None, heard: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, where each set begins, fp) of a task's sets; of equal sets that a task meets, the first only. heard: gets the words of every SAMPLED-th piece."""
    seen: set[tuple[int, int]] = set()
    k = 0
    for batch in batches:
        for _, part in pieces(batch.column(1)):
            g, at = distinct_sets(part, n, frequent, None if k % SAMPLED else heard)
            k += 1
            fp, fp2 = prints(g, at)
            size = np.diff(at)
            size = size[size > 0]
            new = np.zeros(len(fp), bool)
            for i, key in enumerate(zip(fp.tolist(), fp2.tolist())):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            if new.any():
                yield g[np.repeat(new, size)], np.concatenate(([0], np.cumsum(size[new]))), fp[new]


def frequent_ngrams(docs: DataFrame, n: int) -> Frequent:
    """At most FREQUENT n-grams that occur in the most sets, and shares of at most WORDS words.

    Every document is counted, in chunks; what is rare within each chunk is left out, so that little is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        heard: list[np.ndarray] = []
        total = 0

        def often(parts: list[np.ndarray], kind: int) -> pa.RecordBatch:
            """kind: 0 of n-grams, 1 of words; a row of kind 2 has the number of n-grams."""
            g = np.sort(np.concatenate(parts))
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
            k = np.diff(np.append(at, len(g)))
            kinds = np.full(int((k >= OFTEN).sum()), kind)
            at, k, all_of = at[k >= OFTEN], k[k >= OFTEN], len(g)
            g = g[at].view(np.int64)
            if not kind:
                g, k, kinds = np.append(g, 0), np.append(k, all_of), np.append(kinds, 2)
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(g), pa.array(k.astype(np.int64))], ["kind", "g", "n"])

        for g, _, _ in different_sets(batches, n, heard=heard):
            held.append(g)
            total += len(g)
            if total >= CHUNK:
                yield often(held, 0)
                held, total = [], 0
            if sum(map(len, heard)) >= CHUNK:
                yield often(heard, 1)
                heard.clear()
        if held:
            yield often(held, 0)
            held.clear()
        if heard:
            yield often(heard, 1)
            heard.clear()
        release()

    counts = docs.mapInArrow(run, "kind int, g long, n long").groupBy("kind", "g").agg(F.sum("n").alias("n")).checkpoint()
    # the least count that so many n-grams reach; counts above 10,000 are one step
    steps = counts.where("kind = 0").groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("grams")).collect()
    cut, total = 10_000, 0
    for r in sorted(steps, key=lambda r: -r.n):
        total += r.grams
        if total > FREQUENT:
            break
        cut = r.n
    rows = counts.where("kind = 0").where(F.col("n") >= cut).limit(FREQUENT).toArrow()
    heard = counts.where("kind = 1").orderBy(F.desc("n"), "g").limit(WORDS).toArrow()
    every = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    return Frequent(*(x for t in (rows, heard) for x in (t.column("g").to_numpy().view(np.uint64), t.column("n").to_numpy())), every, n)


def blocks(docs: DataFrame, n: int, t: float, frequent: Frequent, parts: int) -> DataFrame:
    """key, fp: a row for every block that a set emits, in TASK_ROWS a task about."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, at, fp in different_sets(batches, n, shared.value):
            key, who = block_keys(g, at, fp, t, shared.value, parts)
            for s in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 100_000]), pa.array(who[s : s + 100_000])], ["key", "fp"])
        release()

    rows = docs.mapInArrow(run, "key long, fp long")
    return rows.repartitionById(parts, F.shiftrightunsigned("key", PART).cast("int"))


def counted(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2**32, and how often each occurs."""
    code = np.sort(np.concatenate([(x << 32) | y for x, y in zip(a, b)])) if a else np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[at] >> 32, code[at] & 0xFFFFFFFF, np.diff(np.append(at, len(code)))


def candidates(key: np.ndarray, fp: np.ndarray, t: float) -> Iterator[pa.RecordBatch]:
    """a, b, n, star: pairs a < b of sets that share n small blocks; the centre and each set of large ones, n blocks each."""
    window = math.ceil(-math.log2(t) * CODES) + 1

    def packed(a: list[np.ndarray], b: list[np.ndarray], star: bool) -> Iterator[pa.RecordBatch]:
        x, y, n = counted(a, b)
        for s in range(0, len(x), 100_000):
            part = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[x[part]]), pa.array(names[y[part]]), pa.array(n[part].astype(np.int64)), pa.array(np.full(len(x[part]), star))], ["a", "b", "n", "star"])

    order = np.argsort(key)
    key, fp = key[order], fp[order]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] = same
    several[:-1] |= same
    key, fp = key[several], fp[several]
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[new], fp[new]
    names, fp = np.unique(fp, return_inverse=True)  # numbers in the order of fp
    code = names >> 52
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    lengths = np.diff(np.append(starts, len(key)))
    a, b, held = [], [], 0
    for n in range(2, SMALL + 1):
        at = starts[lengths == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 1_000_000 // len(i))
        for s in range(0, len(at), step):
            base = at[s : s + step, None]
            x, y = fp[(base + i).ravel()], fp[(base + j).ravel()]
            near = code[y] - code[x] <= window
            a.append(x[near])
            b.append(y[near])
            held += len(a[-1])
            if held > 4_000_000:
                yield from packed(a, b, False)
                a, b, held = [], [], 0
    yield from packed(a, b, False)
    large = lengths > SMALL
    if large.any():
        yield from packed([np.repeat(fp[starts[large]], lengths[large])], [fp[np.repeat(large, lengths)]], True)


def meeting(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            key, fp = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            parts.clear()
            yield from candidates(key, fp, t)
            del key, fp
        release()

    return run


def products(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all members with each other."""
    n = len(members)
    grams = np.concatenate(members)
    row = np.repeat(np.arange(n), [len(g) for g in members])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    col = np.cumsum(new) - 1
    often = np.diff(np.append(np.flatnonzero(new), len(grams)))[col] > 1  # the others are in no intersection of two
    row, col = row[often], np.cumsum(new[often]) - 1
    out = np.zeros((n, n), np.float32)
    width = max(256, min(16384, 8_000_000 // n))
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [s, s + width])
        dense = np.zeros((n, min(width, int(col[-1]) + 1 - s)), np.float32)
        dense[row[lo:hi], col[lo:hi] - s] = 1
        out += dense @ dense.T
    return out


def intersections(members: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of members a[i] and b[i]."""
    if len(a) > 4 * len(members):
        return products(members)[a, b].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = members[x], members[y]
        if len(p) > len(q):
            p, q = q, p
        at = np.searchsorted(q, p)
        out[i] = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return out


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n numbers, the least that each is joined to by pairs a[i], b[i], over any number of them."""
    root = np.arange(n)
    while True:
        before, low = root.copy(), np.minimum(root[a], root[b])
        # the roots of both ends are joined too, so that a long chain takes few rounds
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == before).all():
            return root


def verifier(n: int, t: float, as_pairs: bool):
    def verify(group: pa.Table) -> pa.Table:
        """group: fp, fp2, doc, copies, partners (fp of some), side, star, stars, text; a row for each set, or more where ids repeat.

        In a neighbourhood (star is null) each set is compared with its partners, in a star with all sets, or all of the other side.
        """
        own = list(zip(group.column("fp").to_pylist(), group.column("fp2").to_pylist()))
        lists = group.column("partners").to_pylist()
        members: dict[tuple[int, int], np.ndarray] = {}
        row: list[int] = []
        first = 0
        for chunk in group.column("text").chunks:
            for a, part in pieces(chunk):
                g, at = distinct_sets(part, n)
                filled = np.flatnonzero(np.diff(at) > 0)
                for i, key in zip(filled, zip(*(x.tolist() for x in prints(g, at)))):
                    # an id may repeat with other texts: only a text whose set is the class's own counts
                    if key == own[first + a + i] and key not in members:
                        members[key] = g[at[i] : at[i + 1]]
                        row.append(first + a + int(i))
            first += len(chunk)
        keys = list(members)
        place: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            place.setdefault(key[0], []).append(i)
        star, stars = group.column("star")[0].as_py(), group.column("stars").to_pylist()
        stars = [set(stars[i] or ()) for i in row]
        sized = np.asarray([len(members[k]) for k in keys], np.int64)
        if star is None:
            ends = [(i, j) for i in range(len(keys)) for p in set(lists[row[i]] or ()) for j in place.get(p, ()) if stars[i].isdisjoint(stars[j])]
            a, b = np.asarray([e[0] for e in ends], np.int64), np.asarray([e[1] for e in ends], np.int64)
            both = intersections([members[k] for k in keys], a, b) if len(a) else np.empty(0, np.int64)
        elif len(keys) > 1:
            side = group.column("side").to_numpy()[row]
            product = products([members[k] for k in keys])
            near = np.triu(product >= t * (sized[:, None] + sized[None, :] - product) - EPS, 1)
            a, b = np.nonzero(near & ((side[:, None] != side[None, :]) | (side[:, None] == 0)))
            kinds = {k: x for x, k in enumerate(dict.fromkeys(map(frozenset, stars)))}
            if len(kinds) > 1:
                kind = np.asarray([kinds[frozenset(x)] for x in stars], np.int64)
                code, back = np.unique(kind[a] * len(kinds) + kind[b], return_inverse=True)
                kinds = list(kinds)
                first = np.asarray([min(kinds[x // len(kinds)] & kinds[x % len(kinds)]) == star for x in code.tolist()], bool)[back]
                a, b = a[first], b[first]
            both = product[a, b].astype(np.int64)
        else:
            a = b = both = np.empty(0, np.int64)
        union = sized[a] + sized[b] - both if len(a) else both
        keep = both >= t * union - EPS
        both, union, a, b = both[keep], union[keep], a[keep], b[keep]
        doc = group.column("doc").take(pa.array(row, pa.int64()))
        if as_pairs:
            return pa.table([doc.take(pa.array(a)), doc.take(pa.array(b)), pa.array(both / union)], names=["a", "b", "jaccard"])
        copies = group.column("copies").to_numpy()[row]
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        roots = pa.array(least_joined(len(keys), a, b))
        linked = pa.array(np.flatnonzero(links), pa.int64())
        out = [pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1)] + [doc, doc.take(roots), pa.array(links)]
        return pa.table([x.take(linked) for x in out], names=["fp", "fp2", "doc", "root", "links"])

    return verify


def prepared(docs: DataFrame, id_col: str, text: str, t: float) -> DataFrame:
    if not 0 < t < 1:
        raise ValueError("threshold must be between 0 and 1")
    ensure_workers(docs.sparkSession)
    ensure_checkpoint_dir(docs.sparkSession)
    return docs.select(c(id_col).alias("doc"), c(text).cast("string").alias("text")).where("doc is not null")


def class_rows(sig: DataFrame) -> DataFrame:
    """fp, fp2, size, doc (the least), copies (ids) of each class of equal sets."""
    once = sig.where("fp is not null").dropDuplicates(["fp", "fp2", "doc"])
    return once.groupBy("fp", "fp2").agg(F.first("size").alias("size"), F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies")).checkpoint()


def verified(docs: DataFrame, classes: DataFrame, n: int, t: float, as_pairs: bool = False) -> DataFrame:
    """fp, fp2, doc, root, links (a part of each) of the linked classes; or their pairs. docs: doc, text."""
    sc = docs.sparkSession.sparkContext
    docs = docs.where("text is not null")
    rows = classes.agg(F.sum(F.col("size") * ((1 - t) + 1 / EXTRA) + 5)).first()[0] or 0
    parts = min(1 << 19, max(math.ceil(rows / TASK_ROWS), sc.defaultParallelism))
    found = blocks(docs, n, t, frequent_ngrams(docs, n), parts).mapInArrow(meeting(t), "a long, b long, n long, star boolean")
    found = found.groupBy("a", "b", "star").agg(F.sum("n").alias("n"))
    seen = F.col("n") + F.when(F.col("star"), 0.0).otherwise(spare(F.col("a"), t) + spare(F.col("b"), t))
    found = found.withColumn("near", enough(F.col("a"), F.col("b"), seen, t)).where("star or near").checkpoint()
    grams = F.pow(F.lit(2.0), (F.shiftright("fp", 52) + 1) / CODES)
    buckets = F.greatest(F.ceil(F.count(F.lit(1)) / BUCKET), F.ceil(F.sum(grams) / BUCKET_GRAMS)).cast("int").alias("buckets")

    # stars, merged into the first star of which their centre is a candidate
    first = found.where("star and near and a <> b").groupBy(F.col("b").alias("a")).agg(F.min("a").alias("first"))
    star = found.where("star").join(first, "a", "left").groupBy(F.coalesce("first", "a").alias("star"), F.col("b").alias("fp")).agg(F.sum("n").alias("n"))
    weakest = F.sum("n").over(Window.partitionBy("fp").orderBy("n", "star").rowsBetween(Window.unboundedPreceding, 0))
    star = star.withColumn("unseen", weakest).withColumn("left", F.col("unseen") <= spare(F.col("fp"), t)).checkpoint()
    unseen = star.where("left").groupBy("fp").agg(F.max("unseen").alias("unseen"))
    star = star.where("not left").select("star", "fp")
    stars = star.groupBy("fp").agg(F.collect_list("star").alias("stars"))
    several = star.groupBy("star").agg(buckets, F.count(F.lit(1)).alias("n")).where("n > 1").select("star", "buckets")
    cut = star.join(several, "star").withColumn("u", F.pmod(F.xxhash64("fp"), "buckets")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    side = F.when(F.col("u") == F.col("v"), 0).when(F.col("u") < F.col("v"), 1).otherwise(2)
    in_stars = cut.select(F.xxhash64("star", F.least("u", "v")).alias("g"), F.xxhash64("star", F.greatest("u", "v")).alias("h"), "fp", F.lit(None).cast("array<long>").alias("partners"), side.alias("side"), "star")

    # pairs: a set's neighbourhood is that of its least neighbour; large ones are cut into buckets
    pairs = found.where("not star").join(unseen.toDF("a", "ua"), "a", "left").join(unseen.toDF("b", "ub"), "b", "left")
    pairs = pairs.where(enough(F.col("a"), F.col("b"), F.col("n") + F.coalesce("ua", F.lit(0)) + F.coalesce("ub", F.lit(0)), t)).select("a", "b").checkpoint()
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "o")
    label = both.groupBy("fp").agg(F.least("fp", F.min("o")).alias("label"))
    large = label.groupBy("label").agg(buckets).where("buckets > 1")
    node = label.join(large, "label", "left").select("fp", F.xxhash64("label", F.pmod(F.xxhash64("fp"), F.coalesce("buckets", F.lit(1)))).alias("g")).checkpoint()
    grouped = pairs.join(node.toDF("a", "ga"), "a").join(node.toDF("b", "gb"), "b").select(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h"), "a", "b")
    ends = grouped.select("g", "h", F.col("a").alias("fp"), "b").union(grouped.select("g", "h", F.col("b"), F.lit(None).cast("long")))
    in_pairs = ends.groupBy("g", "h", "fp").agg(F.collect_list("b").alias("partners")).select("*", F.lit(0).alias("side"), F.lit(None).cast("long").alias("star"))

    member = in_stars.unionByName(in_pairs).join(stars, "fp", "left").join(classes.select("fp", "fp2", "doc", "copies"), "fp").checkpoint()
    n_rows, n_ids = member.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.size("partners"), F.lit(0)) + F.coalesce(F.size("stars"), F.lit(0))), F.lit(0))).first()
    fits = n_rows * 150 + n_ids * 8 <= BROADCAST_MB * 1_000_000
    texts = docs.join(F.broadcast(member) if fits else member, "doc").select("g", "h", "star", "fp", "fp2", "doc", "copies", "partners", "side", "stars", "text")
    kind = docs.schema["doc"].dataType.simpleString()
    return texts.groupBy("g", "h", "star").applyInArrow(verifier(n, t, as_pairs), f"a {kind}, b {kind}, jaccard double" if as_pairs else f"fp long, fp2 long, doc {kind}, root {kind}, links long")


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """doc_a, doc_b, jaccard of linked classes of equal sets: see the module."""
    docs = prepared(docs, id_col, text, t)
    found = verified(docs, class_rows(signatures(docs, n)), n, t, as_pairs=True)
    return found.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links: see the module."""
    docs = prepared(docs, id_col, text, t)
    sig = signatures(docs, n).checkpoint()
    classes = class_rows(sig)
    found = verified(docs, classes, n, t).checkpoint()
    links = found.groupBy("fp", "fp2").agg(F.sum("links").alias("linked"))
    roots = components(found.select("doc", "root"), "doc", "root")
    several = classes.join(links, ["fp", "fp2"], "left").where("copies > 1 or linked is not null")
    several = several.join(roots.select(F.col("node").alias("doc"), F.col("root").alias("class")), "doc", "left")
    several = several.select("fp", "fp2", F.coalesce("class", "doc").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    out = sig.dropDuplicates(["fp", "fp2", "doc"]).join(several, ["fp", "fp2"], "left")
    return out.groupBy(F.col("doc").alias("doc_id")).agg(F.min(F.coalesce("class_id", "doc")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose class has a document of smaller id (rows of null id or text stay)."""
    (node,) = fresh(docs, "jaccard_node")
    gone = jaccard_join(docs, id_col, text, n, t).where("class_id <> doc_id").select(F.col("doc_id").alias(node))
    return docs.join(gone, c(id_col) == c(node), "left_anti")


def oracle_sql(n: int = N, t: float = THRESHOLD) -> str:
    """Brute force over an index of all n-grams, and the closure of what it links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n} + 2)] END)) AS g FROM w WHERE len(w) > 0),
cls AS MATERIALIZED (SELECT g, min(doc_id) AS doc, count(*) AS copies, row_number() OVER () AS k FROM g GROUP BY g),
idx AS MATERIALIZED (SELECT k, len(g) AS n, unnest(g) AS x FROM cls),
hit AS (SELECT a.k AS ka, b.k AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter FROM idx a JOIN idx b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= {t} * greatest(a.n, b.n) - 1e-9 GROUP BY ALL),
near AS MATERIALIZED (SELECT ka, kb FROM hit WHERE inter >= {t} * (na + nb - inter) - 1e-9),
edge AS MATERIALIZED (SELECT ka AS u, kb AS v FROM near UNION ALL SELECT kb, ka FROM near),
linked AS (SELECT u AS k, sum(c.copies) AS n FROM edge JOIN cls c ON c.k = v GROUP BY u),
hop AS MATERIALIZED (SELECT DISTINCT a.doc AS u, b.doc AS v FROM edge JOIN cls a ON a.k = u JOIN cls b ON b.k = v),
reach AS (SELECT u AS node, v AS other FROM hop UNION SELECT node, v FROM reach JOIN hop ON hop.u = reach.other),
root AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),
own AS (SELECT g.doc_id, coalesce(root, doc) AS class_id, copies - 1 + coalesce(linked.n, 0) AS links FROM g JOIN cls ON cls.g = g.g LEFT JOIN linked ON linked.k = cls.k LEFT JOIN root ON root.node = cls.doc)
SELECT d.doc_id, min(coalesce(class_id, d.doc_id)) AS class_id, coalesce(sum(links), 0)::BIGINT AS links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN own ON own.doc_id = d.doc_id GROUP BY d.doc_id
"""
