"""Operator 2: SentencePiece encoding and decoding.

Encoding finds the segmentation of the normalised text into vocabulary pieces with the greatest sum of log scores (unigram
Viterbi). Pieces are found in a double-array trie. A character that no piece covers scores 10 below the least piece and is
written as its bytes; decoding joins bytes again, turns the white-space marker into spaces and drops the first one.

Where no piece holds the marker behind another character, the best segmentation of a text is that of its marker-separated
words one after the other, so words are segmented once and looked up afterwards. Ties go to the segmentation whose last
piece is longest.

Defined cases: a null or empty text has no ids and decodes to ''; repeated rows are encoded each by itself; an empty table
gives an empty table; only the two named columns are read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspark.llm.chunks import ChunkCache, Chunks, between, free_separator, gathered
from lexspark.llm.shared import record_batch, slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class DoubleArrayTrie:
    """Bytes of pieces in two arrays: the child of s by byte c is t = base[s] + c + 1 if check[t] == s.

    The child by the end code 0 holds the piece's number as -1 - base.
    """

    def __init__(self, pieces: list[tuple[bytes, int]]):
        pieces = sorted(pieces)
        size = max(1024, 4 * sum(len(p) for p, _ in pieces) + 1024)
        base, check = [0] * size, [-1] * size
        check[0] = 0
        free = 1
        todo = [(0, 0, len(pieces), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            codes: list[tuple[int, int, int]] = []
            i = low
            while i < high:
                code = pieces[i][0][depth] + 1 if depth < len(pieces[i][0]) else 0
                j = i
                while j < high and (pieces[j][0][depth] + 1 if depth < len(pieces[j][0]) else 0) == code:
                    j += 1
                codes.append((code, i, j))
                i = j
            while check[free] >= 0:
                free += 1
            at = max(1, free - codes[0][0])
            while any(check[at + c] >= 0 for c, _, _ in codes):
                at += 1
                if at + 300 > len(base):
                    base += [0] * len(base)
                    check += [-1] * len(check)
            base[state] = at
            for c, i, j in codes:
                check[at + c] = state
                if c == 0:
                    base[at] = -1 - pieces[i][1]
                else:
                    todo.append((at + c, i, j, depth + 1))
        self.base, self.check = base, check


class UnigramPieces:
    """Encoder and decoder of a SentencePiece model file's pieces and scores."""

    def __init__(self, model_file: str, limit: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m, size = self.model, self.model.get_piece_size()
        self.byte_id, self.byte_of, normal = {}, {}, []
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        self.unknown = m.unk_id()
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                normal.append(i)
        self.silent = {i for i in range(size) if m.is_control(i)}
        self.scores = [m.get_score(i) for i in range(size)]
        self.unknown_score = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        self.trie = DoubleArrayTrie([(self.pieces[i].encode(), i) for i in normal])
        # A cut before a marker is safe if no piece crosses it: only pieces of markers alone may hold several.
        self.cuttable = not any(MARK in self.pieces[i].lstrip(MARK) for i in normal)
        self.known = ChunkCache(lambda words: [np.array(self.best(w), "<u4").tobytes() for w in words], limit)
        shown = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else " \u2047 ".encode() if i == self.unknown else p.encode() for i, p in enumerate(self.pieces)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.fromiter(map(len, shown), np.int64, size)
        self.shown_from = np.cumsum(self.shown_size) - self.shown_size

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of normalised text."""
        data = text.encode()
        n = len(data)
        base, check, scores, low = self.trie.base, self.trie.check, self.scores, float("-inf")
        score, source, chosen = [low] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            here = score[at]
            if here == low:
                continue
            lead = data[at]
            one = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            whole, state = False, 0
            for end in range(at, n):  # down the trie, past every piece that begins here
                child = base[state] + data[end] + 1
                if check[child] != state:
                    break
                state = child
                leaf = base[child]
                if check[leaf] == child and base[leaf] < 0:
                    piece = -1 - base[leaf]
                    value = here + scores[piece]
                    if value > score[end + 1]:
                        score[end + 1], source[end + 1], chosen[end + 1] = value, at, piece
                    whole = whole or end + 1 == one
            if not whole and (value := here + self.unknown_score) > score[one]:
                score[one], source[one], chosen[one] = value, at, -1
        out: list[int] = []
        at = n
        while at:
            start, piece = source[at], chosen[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out += [self.byte_id[b] for b in reversed(data[start:at])]
            else:
                out.append(self.unknown)
            at = start
        return out[::-1]

    def normalized(self, texts: list[str]) -> list[str]:
        return [self.model.normalize(t) if t else "" for t in texts]

    def encode(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole normalised texts, one after the other, and the end of each text."""
        separator = free_separator(normal) if self.cuttable else None
        if separator is None:
            words = Chunks(normal, np.arange(len(normal)), np.arange(1, len(normal) + 1))
        else:
            words = between([re.sub(f"(?<!{MARK}){MARK}", separator + MARK, t) if MARK * 2 in t else t.replace(MARK, separator + MARK) for t in normal], separator)
        return gathered(self.known.values(words.words), words)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The normalised texts of ids, with spaces for markers and without the one that normalisation put in front."""
        size = self.shown_size[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.shown_from[ids] - stops[:-1], size)
        at += np.arange(len(at))
        data = self.shown[at].tobytes()
        cuts = [0, *stops[ends].tolist()]
        return [data[a:b].decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") for a, b in zip(cuts, cuts[1:])]


_LOADED: dict[str, UnigramPieces] = {}


def loaded(model_file: str) -> UnigramPieces:
    if model_file not in _LOADED:
        _LOADED[model_file] = UnigramPieces(model_file)
    return _LOADED[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array) of every row of ``docs``. No shuffle."""

    def run(batches):
        for b in slices(batches):
            own = loaded(model_file)
            ids, ends = own.encode(own.normalized(texts_of(b)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view("<i4")))
            yield record_batch({"doc_id": b.column("doc_id"), "ids": lists}, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""

    def run(batches):
        for b in batches:
            lists = [np.array(x or (), np.int64) for x in b.column("ids").to_pylist()]
            texts = loaded(model_file).decode(np.concatenate([np.empty(0, np.int64), *lists]), np.cumsum([len(x) for x in lists], dtype=np.int64))
            yield record_batch({"doc_id": b.column("doc_id"), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the normalised text again, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        for b in slices(batches):
            own = loaded(model_file)
            normal = own.normalized(texts_of(b))
            ids, ends = own.encode(normal)
            whole = [n.replace(MARK, " ").removeprefix(" ") == d for n, d in zip(normal, own.decode(ids, ends))]
            cuts = [0, *ends.tolist()]
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:])]
            yield record_batch({"doc_id": b.column("doc_id"), "n_pieces": np.diff(cuts), "ids_crc32": crc, "round_trip": whole}, schema)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
