"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as one symbol per byte in a doubly linked list. A heap holds the ranks of adjacent
pairs; the lowest rank (leftmost on ties) is merged again and again until no adjacent pair has a rank. The
count of tokens is the number of initial symbols minus the number of merges; no ids are made.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each by itself; only
the two named columns are read, so any other columns, null or not, and clashing names don't matter; an empty
table gives an empty result. Texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm.chunks import ChunkCache, byte_alphabet, text_chunks
from lexspark.llm.shared import record_batch, slices, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_merged(symbols, ranks: dict) -> int:
    """Number of symbols that are left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # A stale entry names a symbol that is gone, or a pair that has changed since.
        if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class HeapCounter:
    """Counts tokens of strings; pre-tokens that were counted already are looked up."""

    def __init__(self, path: str, limit: int = 500_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = str.maketrans(byte_alphabet())
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a.translate(back), b.translate(back)): k for k, (a, b) in enumerate(pairs)}
        self.back = back
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.at_specials = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.library_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}
        self.limit = limit

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens as strings with one character per byte.

        Beyond the Latin blocks the library's own splitter is asked, as Unicode versions differ in newer letters.
        """
        if max(piece) < "ɐ":
            return [p.encode().decode("latin-1") for p in self.find(piece)]
        return [p.translate(self.back) for p, _ in self.library_split(piece)]

    def count(self, piece: str) -> int:
        if not piece:
            return 0
        total = 0
        if self.at_specials and any(s in piece for s in self.specials):
            total += len(self.at_specials.findall(piece))
            return total + sum(map(self.count, self.at_specials.split(piece)))
        for p in self.pre_tokens(piece):
            n = self.known.get(p)
            if n is None:
                n = count_merged(p, self.ranks)
                if len(p) <= 64:
                    self.known[p] = n
            total += n
        return total

    def count_all(self, pieces: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        return [self.count(p) for p in pieces]


_COUNTERS: dict[str, ChunkCache] = {}


def token_counts(texts: list[str], path: str) -> list[int]:
    if path not in _COUNTERS:
        _COUNTERS[path] = ChunkCache(HeapCounter(path).count_all)
    chunks = text_chunks(texts)
    if not len(chunks.ends):
        return []
    counts = np.array(_COUNTERS[path].values(chunks.words), np.int64)[chunks.numbers]
    return np.add.reduceat(counts, np.concatenate([[0], chunks.ends[:-1]])).tolist()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""

    def count(batches):
        for b in slices(batches):
            texts = texts_of(b)
            n = token_counts(texts, tokenizer_path)
            yield record_batch({"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}, _ARROW)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, SCHEMA)
