"""Operator 13: alignment of two tokenizers' tokens over the same bytes.

A text's bytes are labelled: none, end of an A token, end of a B token, or both. A regular expression scans the labels up to
each "both"; the ends in such a span are the tokens of a group, and all its A and B tokens are linked.

Before a single space between two characters that aren't white space both tokenizers begin a new token whatever stands around
it (see ``chunks``; no piece of B holds its space marker behind another character), so the parts between such places are
encoded and labelled once while they stay in the worker's cache, and a text's groups are those of its parts. A text with a
part whose bytes don't come out again is encoded as a whole to see whether its own bytes do.

How many documents hold an id pair linked is counted in three steps. Tasks align blocks of documents (about ``BLOCK_BYTES`` of
text, or one longer document) and write each block as a row: its documents, and its different pairs with the number of its
documents that hold them. The pairs are summed. Each block asks once for each of its pairs, so that the most common pair is
one row a block, and gets counts with which its documents' links are added up.

Defined cases: a text that is null or empty, or whose joined A or B bytes differ from it with a space before it, has no tokens
(zeros and ''); each row counts as a document, also where rows are equal or have no doc_id; an empty table gives no rows; only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.chunks import Chunks, between, byte_alphabet, free_separator, id_encoder
from lexspark.llm.shared import WORKER_CACHES, forget_others, record_batch, single_threaded_tokenizers, slices, stored, texts_of

MARK = "▁"
BLOCK_BYTES = 4_000_000
#: Blocks of a stored file, and about as many of a task that adds up their documents: what a task holds doesn't grow with the table.
BLOCKS = 8
NONE, A_END, B_END, BOTH = range(4)
_GROUP = re.compile(rb"[^\x03]*\x03")
_ADJACENT = re.compile(r"\s\s")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
#: An id pair is one number: A's id above the bits of B's.
B_BITS = 24


class Part(NamedTuple):
    """What a stretch of text has: counts, its groups as written, and the pair of every link."""

    n_a: int
    n_b: int
    n_groups: int
    written: str
    links: bytes


class Parts(NamedTuple):
    """Different parts; for all texts in order the numbers of their parts; for each text the end of its parts (it has none if
    it has no tokens)."""

    found: list[Part | None]
    numbers: np.ndarray
    ends: np.ndarray

    def total(self, of) -> np.ndarray:
        """The sum of a number of each part over each text."""
        each = np.array([of(p) if p else 0 for p in self.found], np.int64)
        return np.diff(np.concatenate([[0], np.cumsum(each[self.numbers])])[np.concatenate([[0], self.ends])])

    def counts(self) -> dict[str, np.ndarray]:
        return {"n_a": self.total(lambda p: p.n_a), "n_b": self.total(lambda p: p.n_b), "n_groups": self.total(lambda p: p.n_groups), "n_links": self.total(lambda p: len(p.links) // 8)}

    def written(self) -> list[str]:
        each = [p.written if p else "" for p in self.found]
        numbers = self.numbers.tolist()
        cuts = [0, *self.ends.tolist()]
        return [";".join(map(each.__getitem__, numbers[x:y])) for x, y in zip(cuts, cuts[1:])]


class Aligner:
    """Two tokenizers, A a byte-level one of the tokenizers library, B a SentencePiece model that puts a space in front."""

    def __init__(self, a_file: str, b_file: str, limit: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer

        single_threaded_tokenizers()
        self.a = Tokenizer.from_file(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        shown = byte_alphabet()
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        bytes_of = lambda t: "".join(shown[c] for c in t).encode("latin-1") if all(c in shown for c in t) else t.encode()
        self.a_bytes = {i: bytes_of(t) for i, t in entries}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces}
        silent = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i) for i, _ in pieces]
        self.cuttable = not any(MARK in p.lstrip(MARK) for (_, p), s in zip(pieces, silent) if not s)
        self.a_size, self.b_size = (np.array([len(table.get(i, b"")) for i in range(max(table) + 1)], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.signed = [f"{i}{sign}" for i in range(max(len(self.a_size), len(self.b_size))) for sign in ",|;"]
        self.a_cache = id_encoder(a_file)
        self.special = [t.content for t in self.a.get_added_tokens_decoder().values()]
        self.known: dict[str, Part | None] = {}
        self.limit = limit
        WORKER_CACHES.append(self.known)

    def a_ids(self, texts: list[str]) -> list[bytes]:
        """A's ids as unsigned 32-bit numbers; what may hold a special token's string goes to the library as plain text."""
        plain = [t for t in texts if not any(x in t for x in self.special)]
        found = dict(zip(plain, self.a_cache.compute(plain)))
        rest = [t for t in texts if t not in found]
        found.update((t, np.array(e.ids, "<u4").tobytes()) for t, e in zip(rest, self.a.encode_batch_fast(rest, add_special_tokens=False)))
        return [found[t] for t in texts]

    def aligned(self, texts: list[str]) -> list[Part | None]:
        """What each text (with its space before it) has; None where its bytes don't come out again."""
        data, a, b = [t.encode() for t in texts], self.a_ids(texts), self.b.encode([t[1:] for t in texts], num_threads=1)
        a_flat, b_flat = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        out_again = lambda flat, table: b"".join(map(table.__getitem__, flat.tolist()))
        if out_again(a_flat, self.a_bytes) == out_again(b_flat, self.b_bytes) == b"".join(data):
            a_ends, b_ends = np.cumsum(self.a_size[a_flat]), np.cumsum(self.b_size[b_flat])
            ends = np.cumsum([len(x) for x in data], dtype=np.int64)
            if np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all():
                return self.grouped(a_flat, b_flat, a_ends, b_ends, ends)
        if len(texts) == 1:
            return [None]
        own = [b"".join(self.a_bytes[i] for i in np.frombuffer(x, "<u4").tolist()) == d == b"".join(self.b_bytes[i] for i in y) for d, x, y in zip(data, a, b)]
        good = iter(self.aligned([t for t, ok in zip(texts, own) if ok]) if any(own) else [])
        return [next(good) if ok else None for ok in own]

    def grouped(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, ends: np.ndarray) -> list[Part]:
        """The parts of texts that stand one after the other: ids, and the ends of tokens and of texts in bytes."""
        labels = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
        labels[a_ends - 1] |= A_END
        labels[b_ends - 1] |= B_END
        spans = np.fromiter((m.end() for m in _GROUP.finditer(labels.tobytes())), np.int64)
        # The labels in a span tell how many tokens of each kind its group has.
        a_to, b_to = (np.cumsum(labels & kind != 0)[spans - 1] for kind in (A_END, B_END))
        in_a, in_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        group_of_a, group_of_b = np.repeat(np.arange(len(spans)), in_a), np.repeat(np.arange(len(spans)), in_b)
        # Written: an id with the sign behind it, A's of a group before B's.
        shown = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_to - 1], last_b[b_to - 1] = 1, 2
        shown[np.arange(len(a)) + (b_to - in_b)[group_of_a]] = 3 * a + last_a
        shown[np.arange(len(b)) + a_to[group_of_b]] = 3 * b + last_b
        written = list(map(self.signed.__getitem__, shown.tolist()))
        # Links: every A token of a group with every B token of it.
        n = in_a * in_b
        group = np.repeat(np.arange(len(spans)), n)
        place = np.arange(len(group)) - (np.cumsum(n) - n)[group]
        links = (a[(a_to - in_a)[group] + place // in_b[group]] << B_BITS | b[(b_to - in_b)[group] + place % in_b[group]]).tobytes()
        to_group = np.searchsorted(spans, ends, "right")
        cuts = [np.concatenate([[0], x[to_group - 1]]).tolist() for x in (a_to, b_to, np.cumsum(n))]
        rows = zip(*(zip(x, x[1:]) for x in (*cuts, [0, *to_group.tolist()])))
        return [Part(i2 - i1, j2 - j1, g2 - g1, "".join(written[i1 + j1 : i2 + j2])[:-1], links[8 * l1 : 8 * l2]) for (i1, i2), (j1, j2), (l1, l2), (g1, g2) in rows]

    def cut(self, texts: list[str]) -> Chunks:
        """The different parts of spaced texts, and which ones each text has."""
        separator = free_separator(texts) if self.cuttable else None
        if separator is None:
            return Chunks(texts, np.arange(len(texts)), np.arange(1, len(texts) + 1))
        marked = [_BOUNDARY.sub(separator, t) if _ADJACENT.search(f"{t} ") else f" {t[1:].replace(' ', f'{separator} ')}" if t else "" for t in texts]
        return between(marked, separator)

    def parts(self, texts: list[str]) -> Parts:
        spaced = [f" {t}" if t else "" for t in texts]
        words, numbers, ends = self.cut(spaced)
        forget_others(self.known)
        if len(self.known) > self.limit:
            self.known.clear()
        fresh = [w for w in words if w and w not in self.known]
        new = dict(zip(fresh, self.aligned(fresh)))
        self.known.update(new)
        found = [self.known[w] if w else None for w in words]
        for w in fresh:
            if len(w) > 64:  # doesn't come again
                del self.known[w]
        bad = np.array([p is None for p in found], bool)
        if bad.any():  # look at those texts whole
            own = np.split(numbers, ends[:-1])
            for k in np.flatnonzero(np.add.reduceat(bad[numbers], np.concatenate([[0], ends[:-1]]), dtype=np.int64)):
                whole = self.aligned([spaced[k]])[0] if len(own[k]) > 1 else None
                own[k] = np.array([len(found)] if whole else [], np.int64)
                found += [whole] if whole else []
            numbers, ends = np.concatenate(own).astype(np.int64), np.cumsum([len(x) for x in own])
        return Parts(found, numbers, ends)


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(a_file: str, b_file: str) -> Aligner:
    key = (a_file, b_file)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


_DOCS = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, written array<string>"
_BLOCK = f"block long, {_DOCS}, pairs array<long>, holders array<int>, ends array<int>, places array<int>, times array<int>"
_ALIGNED = "doc_id long, groups string, n_a long, n_b long, n_groups long, n_links long"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def arrow_schema(ddl: str) -> pa.Schema:
    fields = []
    for name, kind in (x.split() for x in ddl.split(", ")):
        inner = re.fullmatch(r"array<(\w+)>", kind)
        fields.append((name, pa.list_(_KINDS[inner[1]]) if inner else _KINDS[kind]))
    return pa.schema(fields)


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.alias("text"))


def align_tokens(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, groups (``a1,a2|b1;a3|b2``), n_a, n_b, n_groups and n_links of every row of ``docs``. No shuffle."""
    schema = arrow_schema(_ALIGNED)

    def run(batches):
        for b in slices(batches):
            own = loaded(a_file, b_file).parts(texts_of(b))
            yield record_batch({"doc_id": b.column("doc_id"), "groups": own.written()} | own.counts(), schema)

    return slim(docs).mapInArrow(run, _ALIGNED)


def document_cells(own: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of some documents and how many hold each; for each document the end of its cells; and for each
    cell, a document's different pair, the pair's place and how often the document has it."""
    n_docs, links = len(own.ends), [p.links if p else b"" for p in own.found]
    pairs, place = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    size = np.fromiter(map(len, links), np.int64, len(links)) // 8
    document = np.repeat(np.arange(n_docs), np.diff(own.ends, prepend=0))
    # First each document's different parts, then the pairs of these.
    keys, times = np.unique(document * max(1, len(links)) + own.numbers, return_counts=True)
    document, part = np.divmod(keys, max(1, len(links)))
    length = size[part]
    at = np.arange(length.sum()) + np.repeat((np.cumsum(size) - size)[part] - np.cumsum(length) + length, length)
    cells = np.repeat(document, length) * max(1, len(pairs)) + place[at]
    order = np.argsort(cells, kind="stable")
    cells, weight = cells[order], np.repeat(times, length)[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    document, place = np.divmod(cells[first], max(1, len(pairs)))
    times = np.add.reduceat(weight, first) if len(first) else weight
    return pairs, np.bincount(place, minlength=len(pairs)), np.searchsorted(document, np.arange(n_docs), "right"), place, times


def aligned_blocks(docs: DataFrame, a_file: str, b_file: str, block_bytes: int) -> DataFrame:
    schema = arrow_schema(_BLOCK)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for b in slices(batches, block_bytes):
            own = loaded(a_file, b_file).parts(texts_of(b))
            pairs, holders, ends, places, times = document_cells(own)
            row = own.counts() | {"block": block, "doc_ids": b.column("doc_id").to_pylist()}
            row["written"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in own.written()]
            row |= {"pairs": pairs, "holders": holders, "ends": ends, "places": places, "times": times}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
            block += 1

    return slim(docs).mapInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its A id has more)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", B_BITS))  # as many rows as B has entries, at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignment_digests(docs: DataFrame, a_file: str, b_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    blocks = stored(aligned_blocks(docs, a_file, b_file, block_bytes), "aligned-blocks", BLOCKS)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(blocks.count() / BLOCKS))
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(pair_counts(blocks), "pair").select("of", F.struct("place", "n", "best").alias("told"))
    answers = told.repartition(tasks, "of").groupBy("of").agg(F.sort_array(F.collect_list("told")).alias("told")).select("of", F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    schema = arrow_schema(_OUT)

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].values for name in batch.schema.names}
                array = lambda name: np.zeros(0, np.int64) if row[name] is None else row[name].to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                place, times, bounds = array("places"), array("times"), np.concatenate([[0], array("ends")])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])  # noqa: B023, E731
                out = {n: row[n] for n in ("n_a", "n_b", "n_groups", "n_links")} | {"doc_id": row["doc_ids"], "groups_sha256": row["written"]}
                out |= {"n_best": total(array("best")[place] * times), "count_sum": total(array("n")[place] * times)}
                yield record_batch(out, schema)

    own = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "written", "ends", "places", "times").repartition(tasks, "block")
    joined = own.join(answers, F.col("block") == F.col("of"), "left")
    return joined.select("doc_ids", "n_a", "n_b", "n_groups", "n_links", "written", "ends", "places", "times", "n", "best").mapInArrow(sums, _OUT)
