"""Operator 3: line dedup over line hashes, by all stretches rather than by winnowing.

Winnowing selects the minima of windows of fingerprints and guarantees to find runs of a whole window. Here a run of
``min_words`` words is to be found even where it is one line, so a window can hold no more than one fingerprint, and nothing is
left to select; and a selected fingerprint that stands in many surroundings would have to be compared with each of them, as
its first occurrence need not share the run. So every fingerprint is kept, and it is as long as the shortest run, so that
joining it with its first occurrence alone is exact.

The lines with a word are hashed. From each line the shortest stretch of lines that has ``min_words`` words is taken, ahead
and back; each stretch is a fingerprint. A stretch is the
shortest one wherever its lines occur, so equal stretches always meet. Each is joined with its first occurrence, in the
order of (doc_id, text hash, line); the lines of all others are repeated and deleted. Any line of a repeated run of
``min_words`` words or more lies in such a stretch within the run: in the one that ends with the line or, where the run
has too few words up to there, in the one that begins the run. So exactly the lines of runs that begin earlier too go.

Every occurrence is joined with the first one only, so a passage in a third of all documents gives one match each.

Defined cases: null and empty texts have no lines and stay as they are; rows with the same doc_id and the same text count
as one document and are treated alike, rows with the same doc_id and another text as two; a repeat within one document
loses its later part, also where the two overlap; each deleted line stays at an earlier place; stretches are compared by
64-bit hashes; an empty table gives an empty table; all other columns are passed on, whatever
their names, but for the three that are added, which replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.shared import forget_others, record_batch, slices, split_by_keys, stored, texts_of
from lexspark.llm.shingles import mix

_STRETCHES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("prints", pa.list_(pa.int64()))])
#: Odd, so that it has an inverse.
_BASE = 0x9E3779B97F4A7C15


def word_lines(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that have a word."""
    return [(k, line) for k, line in enumerate(text.split("\n")) if line.strip(" \t\r\x0b\x0c")]


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.strip(" \t\r\x0b\x0c").encode()) for x in lines], np.uint64)


def n_words(line: str) -> int:
    return len(line.encode().split())


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def fingerprints(hashes: np.ndarray, words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, end and hash of the shortest stretches of ``min_words`` words that begin or end with each line."""
    n, least = len(hashes), max(1, min_words)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)]).astype(np.int64)
    ends, firsts = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(firsts >= 0)
    both = np.concatenate([ahead * (n + 1) + ends[ahead], firsts[back] * (n + 1) + back + 1])
    first, end = np.divmod(np.unique(both), n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers(_BASE, n)[:n], dtype=np.uint64)])
        prints = mix((sums[end] - sums[first]) * powers(pow(_BASE, -1, 1 << 64), n)[first] + (end - first).astype(np.uint64))
    return first, end, prints.view(np.int64)


def without_repeats(text: str, runs: list[int], min_words: int) -> tuple[str, int, int, int]:
    """The text without its repeated stretches of at least ``min_words`` words; lines, deleted lines, deleted words."""
    lines = text.split("\n")
    own = word_lines(text)
    marked = np.zeros(len(own) + 1, bool)
    for s, e in zip(runs[::2], runs[1::2]):
        marked[s:e] = True
    gone: set[int] = set()
    lost_words = lost_lines = start = 0
    for i, hit in enumerate(marked):
        if hit:
            continue
        words = sum(n_words(line) for _, line in own[start:i])
        if i > start and words >= min_words:
            lost_words += words
            lost_lines += i - start
            gone.update(range(own[start][0], own[i - 1][0] + 1))
        start = i + 1
    return "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, len(lines), lost_lines, lost_words


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, runs): line ranges that occur earlier, numbers first, end, first, end, ..."""

    def stretches_of(batches):
        forget_others()
        for b in slices(batches):
            out: dict[str, list] = {"at": [], "end": [], "prints": []}
            for t in texts_of(b):
                lines = [x for _, x in word_lines(t)]
                for k, v in zip(out, fingerprints(line_hashes(lines), list(map(n_words, lines)), min_words)):
                    out[k].append(v)
            yield record_batch(out | {"doc_id": b.column("doc_id"), "th": b.column("th")}, _STRETCHES)

    stretches = stored(docs.mapInArrow(stretches_of, "doc_id long, th long, at array<int>, end array<int>, prints array<long>").where("size(prints) > 0").dropDuplicates(["doc_id", "th"]), "line-hashes")
    prints = stretches.select("doc_id", "th", F.explode(F.arrays_zip("at", "end", "prints")).alias("p")).select("doc_id", "th", F.col("p.at").alias("at"), F.col("p.end").alias("end"), F.col("p.prints").alias("print"))
    place = F.struct("doc_id", "th", "at")
    firsts = prints.groupBy("print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = prints.join(firsts, "print").where(~place.eqNullSafe(F.col("first")))
    return found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.array("at", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (with doc_id and text) with repeated passages deleted from text, and the columns n_lines,
    n_deleted_lines and n_deleted_words added (in place of any so named)."""
    slim = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    runs = stored(repeated_runs(slim, min_words), "repeated-runs")
    # The row as a whole lies in a struct, so that no added name can clash with its columns.
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).alias("key"), F.struct("*").alias("row"))
    runs = runs.select(F.struct("doc_id", "th").alias("of"), "runs")
    # Only texts that may hold a repeat are shuffled.
    perhaps, untouched = split_by_keys(rows, [F.col("key.doc_id"), F.col("key.th")], runs.select("of.doc_id", "of.th"))
    on = perhaps.key.doc_id.eqNullSafe(runs.of.doc_id) & (perhaps.key.th == runs.of.th)
    joined = perhaps.join(runs, on, "left").select("row", "runs").union(untouched.select("row", F.lit(None).cast("array<int>").alias("runs")))
    names = [n for n in docs.columns if n not in ("n_lines", "n_deleted_lines", "n_deleted_words")]
    added = [("n_lines", pa.int64()), ("n_deleted_lines", pa.int64()), ("n_deleted_words", pa.int64())]

    def apply(batches):
        forget_others()
        for whole in batches:
            row = whole.column("row")
            for b in slices([pa.RecordBatch.from_arrays([*row.flatten(), whole.column("runs")], names=[*(f.name for f in row.type), ""])]):
                own = dict(zip(b.schema.names, b.columns))
                rows = [(None, 0, 0, 0) if t is None else without_repeats(t, r or [], min_words) for t, r in zip(own["text"].to_pylist(), own[""].to_pylist())]
                made = list(zip(*rows))
                columns = [pa.array(made[0], pa.string()) if name == "text" else own[name] for name in names]
                columns += [pa.array(made[k + 1], kind) for k, (_, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in added)])

    schema = T.StructType([*docs.select(*names).schema.fields, *(T.StructField(n, T.LongType()) for n, _ in added)])
    return joined.mapInArrow(apply, schema)
