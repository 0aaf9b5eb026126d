"""Operator 5: packing token sequences by best-fit decreasing.

Every document becomes its ids plus an end id. Overlong documents are first cut into full windows; what is left
is packed, longest first, into the open window with the least room that still holds it. A segment tree indexed by
remaining capacity finds that window. Packing works in blocks of documents inside each task, so nothing is
shuffled and memory is bounded; windows that a block leaves open are dissolved and packed again with the next block.
When the task ends, or they hold over a quarter of a block, their pieces are cut to fill one another, which leaves at
most one padded window.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by itself; a null doc_id stays
null; an empty table gives no pieces; only the two named columns are read. Texts of any length are packed whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.chunks import encode_ids
from lexspark.llm.shared import record_batch, slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class CapacityTree:
    """A segment tree over remaining capacities 0..size; each leaf counts the open windows that have that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least ``need``."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # up until a right sibling has windows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:  # down to its least leaf
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of item numbers; every length is at most ``size``."""
    tree, windows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take_tightest(lengths[i])
        if found is None:
            room, w = size, len(windows)
            windows.append([])
        else:
            room, w = found
        windows[w].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], w)
    return windows


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, block_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their place: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. Pieces of a sequence lie gapless from offset 0."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        counter = TaskContext.get().partitionId() << 32
        left: list[tuple] = []  # pieces (doc_id, start, ids, doc_tokens) to be packed with the next block
        full: list[list[tuple]] = []
        held = 0

        def emit(windows):
            nonlocal counter
            out: dict[str, list] = {f.name: [] for f in _ARROW}
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    n = len(ids) // 4
                    for k, v in zip(out, (doc, start, n, ids, total, counter, offset)):
                        out[k].append(v)
                    offset += n
                counter += 1
            return record_batch(out, _ARROW)

        def close(last: bool):
            nonlocal left, full, held
            windows = [[left[i] for i in w] for w in best_fit_decreasing([len(p[2]) // 4 for p in left], size)]
            done = [w for w in windows if sum(len(p[2]) for p in w) == 4 * size]
            open_ = [w for w in windows if sum(len(p[2]) for p in w) < 4 * size]
            if last or sum(len(p[2]) for w in open_ for p in w) > block_tokens:  # a quarter of the block, in bytes
                done += refill(open_, size)
                left = []
            else:
                left = [p for w in open_ for p in w]
            done, full, held = full + done, [], 0
            for at in range(0, len(done), 512):
                yield emit(done[at : at + 512])

        for b in slices(batches):
            flat, ends = encode_ids(texts_of(b), tokenizer_path)
            for doc, first, stop in zip(b.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                ids = flat[first:stop].tobytes() + end
                total = len(ids) // 4
                cut = total - total % size
                full += [[(doc, at, ids[4 * at : 4 * (at + size)], total)] for at in range(0, cut, size)]
                if cut < total:
                    left.append((doc, cut, ids[4 * cut :], total))
                held += total
                if held >= block_tokens:
                    yield from close(False)
        yield from close(True)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def refill(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """Join windows that aren't full, cutting pieces at the window's end: all but the last are full then."""
    out, room = [], 0
    for w in windows:
        for doc, start, ids, total in w:
            while ids:
                if not room:
                    out.append([])
                    room = size
                part = ids[: 4 * room]
                out[-1].append((doc, start, part, total))
                start += len(part) // 4
                room -= len(part) // 4
                ids = ids[len(part) :]
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary); a group never exceeds one window."""
    part = F.struct("offset", "ids")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts")).select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
