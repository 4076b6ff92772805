"""BPE encoding and decoding with a given vocabulary of merge ranks.

Encoding: the text is cut into pretokens by a pattern; in each, adjacent symbols form a doubly linked list,
and a priority queue holds (merge rank, position) of the adjacent pairs. Popped entries whose symbols have
changed since they were pushed are stale and skipped. That is O(n log n) however long a pretoken is.
Pretokens seen before are looked up in a bounded table of the worker. Decoding concatenates the
vocabulary's byte strings.

The vocabulary is a file of lines "base64 rank"; its path on the driver is a parameter, and Spark sends the file to the executors.

Defined results: a null text has null tokens, n_tokens and text; the empty text has no tokens; text of any length is
encoded whole; rows repeat as given; an empty table gives an empty table; ids that the vocabulary
lacks raise ValueError when decoding. Equal merges (a tie of rank) are made from the left; special tokens' strings are ordinary text; other columns,
whatever their names, are left out of the result.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lucidframe.llm.common import c, ensure_workers, list_array, release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same on ASCII texts, in the standard library's faster engine
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000  # pretokens a worker's table holds before it starts anew


class BPE:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.strings = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN, re.A).findall if pattern == PATTERN else self.find
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0: merged into another
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:  # stale: one of the two symbols is no longer what it was
                continue
            end[i] = stop
            end[j] = 0
            if stop < n:
                left[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find_ascii(text) if text.isascii() else self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        try:
            return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError as e:
            raise ValueError(f"no token {e.args[0]} in the vocabulary") from None


_loaded: dict[tuple[str, str], BPE] = {}


def loaded(path: str, pattern: str) -> BPE:
    if (path, pattern) not in _loaded:
        sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
        _loaded[path, pattern] = BPE(sent if os.path.exists(sent) else path, pattern)
    return _loaded[path, pattern]


def send(docs: DataFrame, path: str) -> None:
    ensure_workers(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, decode: bool = False) -> DataFrame:
    """id, tokens array<int>, n_tokens; with decode also text, concatenated again from the tokens."""
    send(docs, path)
    kind = docs.select(c(id_col)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, tokens array<int>, n_tokens int" + (", text string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                found = [None if t is None else bpe.encode(t) for t in texts]
                tokens = list_array([np.asarray(x or [], np.int32) for x in found], pa.int32(), [x is not None for x in found])
                columns = [part.column(0), tokens, pa.array([None if x is None else len(x) for x in found], pa.int32())]
                if decode:
                    columns.append(pa.array([None if x is None else bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "n_tokens", "text"][: len(columns)])
        bpe.known = {}
        release()

    return docs.select(c(id_col).alias("doc_id"), c(text).cast("string").alias("text")).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """id and text of token lists; null tokens give a null text."""
    send(rows, path)
    kind = rows.select(c(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, PATTERN)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(c(id_col).alias("doc_id"), c(tokens).cast("array<int>").alias("tokens")).mapInArrow(run, f"doc_id {kind}, text string")
