"""Operator 1: quality rules with an isolation forest on rule statistics.

Base rules count words, symbols, repeated lines and repeated 3-word windows and fail the plainly bad texts. The other
verdict comes from an isolation forest: random splits of ratios of these counts, fitted on good labelled rows, give
texts unlike them short path lengths. The score at which a text is rejected is calibrated on all labelled rows that the
base rules pass: the largest share of good rows that may be lost is ``max_good_loss``.

The forest is fitted on at most ``trees * sample`` good labelled rows (25,600), taken in the order of a hash of doc_id;
counts, scores and the calibration cover all rows.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged each by itself;
labels that are null, or contradict each other for a doc_id, are not used; without good labels (an empty table too)
there is no forest and the base rules alone decide; only the named columns are read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.shared import forget_others, least_hashes, record_batch, slices, stored

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
_SPACE, _SYMBOLS, _MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!?.,;:"
_UPPER = bytes(range(65, 91))
STATS_SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in STATS)])
_STATS_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in STATS)])


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts in STATS of a whole text; words are runs of characters other than space and U+0009..U+000D."""
    data = (text or "").encode()
    words = data.split()  # splits at exactly these characters
    chars = len(text or "") - (len(data) - len(data.translate(None, _SPACE)))
    lines, seen, repeated = data.split(b"\n"), set(), 0
    for line in lines:
        if line.strip():
            if line in seen:
                repeated += 1
            seen.add(line)
    return (len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), repeated, repeated_words(words), len(lines),
            len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _MARKS)))


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    hit = bytearray(len(windows))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[j] = 1
    total, end = 0, 0
    for i, h in enumerate(hit):
        if h:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def _stats_columns(texts: list, ids) -> dict:
    rows = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(STATS))
    return {"doc_id": ids} | {c: rows[:, k] for k, c in enumerate(STATS)}


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs``."""

    def count(batches):
        forget_others()
        for b in slices(batches):
            yield record_batch(_stats_columns(b.column("text").to_pylist(), b.column("doc_id")), _STATS_ARROW)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, STATS_SCHEMA)


def features(s) -> np.ndarray:
    """Square roots of ratios of the counts, which a text's length doesn't move; over one symbol a word counts as one."""
    words = np.maximum(np.asarray(s["n_words"], float), 1)
    chars = np.maximum(np.asarray(s["word_chars"], float), 1)
    part = lambda c, of: np.asarray(s[c], float) / of
    return np.sqrt(np.column_stack([chars / words, np.minimum(part("n_symbols", words), 1), part("n_dup_lines", np.maximum(np.asarray(s["n_lines"], float), 1)), part("n_repeat_words", words), part("n_upper", chars), part("n_marks", words)]))


def base_failed(s):
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


class IsolationForest:
    """Trees of random splits; ``score`` is 2 ** (-mean path length / expected length), near 1 for anomalies."""

    def __init__(self, rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = 100, sample: int = 256, seed: int = 7):
        """``box``: least and greatest value of each feature that the splits may fall between, beyond those of ``rows``."""
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        deepest = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        low, high = np.minimum(box[0], rows.min(0)), np.maximum(box[1], rows.max(0))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], low, high, rng, deepest) for _ in range(trees)]

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary search tree of n keys."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows, low, high, rng, deepest):
        """Arrays (feature, cut, left, right, length); a leaf has feature -1 and its path length.

        A split falls anywhere in the node's box, not only between its rows: where no row lies, the path ends at once.
        """
        nodes: list[list[float]] = []
        todo = [(rows, low, high, 0, -1, 0)]
        while todo:
            part, low, high, depth, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(usable):
                nodes.append([-1, 0, 0, 0, depth + self.expected(len(part))])
                continue
            f = rng.choice(usable)
            cut = rng.uniform(low[f], high[f])
            nodes.append([f, cut, 0, 0, 0])
            below = part[:, f] < cut
            left_high, right_low = high.copy(), low.copy()
            left_high[f] = right_low[f] = cut
            todo += [(part[below], low, left_high, depth + 1, me, 0), (part[~below], right_low, high, depth + 1, me, 1)]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = rows[every, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return np.round(2.0 ** (-total / len(self.trees) / max(self.expected(self.sample), 1e-9)), 6)


class QualityModel:
    """A forest and the score from which a text is rejected; without a forest nothing more is rejected."""

    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def judge(self, s) -> dict:
        failed = np.asarray(base_failed(s), bool)
        score = self.forest.score(features(s)) if self.forest and len(failed) else np.zeros(len(failed))
        return {"base_failed": failed, "anomaly_score": score, "kept": ~failed & ((score < self.threshold) if self.forest else True)}


def fit_quality(stats: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, max_good_loss: float = 0.001) -> QualityModel:
    """Fit the forest on good labelled rows and calibrate its threshold on all labelled rows."""
    agreed = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    known = stats.join(agreed, "doc_id").where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    known = stored(known, "labelled-stats")
    good = known.where("quality = 1")
    rows = least_hashes(good, "doc_id", trees * sample, good.count()).toPandas()
    if len(rows) < 2:
        return QualityModel(None, 1.0)
    # The box spans all labelled rows' counts per word or character; a ratio's range is one row of figures.
    spread = known.mapInPandas(lambda parts: (pd.DataFrame(features(p), columns=[f"f{k}" for k in range(6)]) for p in parts if len(p)), ", ".join(f"f{k} double" for k in range(6)))
    ends = spread.agg(*(g(f"f{k}") for g in (F.min, F.max) for k in range(6))).first()
    forest = IsolationForest(features(rows), (np.array(ends[:6]), np.array(ends[6:])), trees, sample)

    def scores(parts):
        for p in parts:
            yield pd.DataFrame({"bin": np.floor(forest.score(features(p)) * 10_000).astype("int64"), "good": (p["quality"] == 1).astype("int64")})

    # At most 10,001 bins of the score come to the driver, whatever the number of labels.
    bins = known.mapInPandas(scores, "bin long, good long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas().sort_values("bin", ascending=False)
    lost = bins["good"].cumsum() <= max_good_loss * bins["good"].sum()
    usable = bins[lost]
    return QualityModel(forest, float(usable["bin"].min()) / 10_000 if len(usable) else 2.0)


def judge_documents(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly_score and kept for every row of ``docs``."""
    stats = stored(rule_stats(docs), "rule-stats")
    model = fit_quality(stats, labels, **fit)

    def judge(parts):
        for p in parts:
            yield p.assign(**model.judge(p))

    return stats.mapInPandas(judge, STATS_SCHEMA + ", base_failed boolean, anomaly_score double, kept boolean")


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are counted again instead of being shuffled."""
    model = fit_quality(stored(rule_stats(docs, id_col, text_col), "rule-stats"), labels, **fit)

    def keep(batches):
        forget_others()
        for b in slices(batches, column=text_col):
            s = _stats_columns(b.column(text_col).to_pylist(), None)
            yield b.filter(pa.array(model.judge(s)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
