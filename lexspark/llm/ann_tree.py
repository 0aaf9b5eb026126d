"""Operator 6: approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on ``fit_rows`` vectors (20,000, or an eighth of all up to ``most_fit_rows``, 200,000; taken in the order
of a hash of vec_id): every node is split by spherical k-means until a leaf would hold at most ``leaf_rows`` of the fitted
vectors. Every vector of the table is then assigned to a leaf. A query walks the tree with a priority queue of branches, nearest first, and so orders the leaves;
it is compared with all vectors of the leaves it visits. How many leaves are visited is widened until the calibrated recall
is reached: for at most ``calibration`` (200) queries the exact neighbours are found by brute force over all vectors, and the
least number of leaves that reaches ``target_recall`` of them is taken.

Equal vectors are stored once with their smallest ids (one more than the neighbours wanted, so that a query can't push
itself out): further copies could never be among the nearest, as ties go to the smaller id. A leaf's vectors and the queries
that visit it are dealt into blocks, and a task gets one block of each, so that a leaf with a large share of all vectors or
queries isn't one task's work.

Defined cases: vectors that are null, zero, of another dimension than most, or that hold null or non-finite components take
no part, neither as query nor as candidate; ties go to the smaller vec_id; with fewer candidates all are returned; rows with
the same vec_id and the same vector are one candidate; an empty table gives an empty table; only the two named columns are
read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.shared import least_hashes, stored

RESULT = "query_id long, rank int, vec_id long, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class KMeansTree:
    """Centres by node; ``children[n]`` is empty for a leaf, whose number is ``leaf[n]``."""

    def __init__(self, rows: np.ndarray, branching: int = 8, leaf_rows: int = 64, rounds: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [rows.mean(axis=0)], [[]], [-1], 0
        todo = [(0, rows)]
        while todo:
            node, part = todo.pop()
            own = self._split(part, branching, rounds, rng) if len(part) > leaf_rows else None
            if own is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for k in np.unique(own):
                inner = part[own == k]
                self.centres.append(inner.mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, inner))
        self.centres = unit(np.array(self.centres) + 1e-300)
        self.children = [np.array(c, int) for c in self.children]

    @staticmethod
    def _split(part, branching, rounds, rng):
        centres = part[rng.choice(len(part), branching, replace=False)]
        for _ in range(rounds):
            own = np.argmax(part @ centres.T, axis=1)
            for k in range(branching):
                if (own == k).any():
                    mean = part[own == k].sum(axis=0)
                    if (size := np.linalg.norm(mean)) > 0:
                        centres[k] = mean / size
        own = np.argmax(part @ centres.T, axis=1)
        return own if len(np.unique(own)) > 1 else None

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        out = np.empty(len(rows), int)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(self.children[node]):
                out[at] = self.leaf[node]
                continue
            own = np.argmax(rows[at] @ self.centres[self.children[node]].T, axis=1)
            todo += [(child, at[own == k]) for k, child in enumerate(self.children[node]) if (own == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in the order of best-bin-first search."""
        queue, out = [(0.0, 0)], []
        while queue and (most is None or len(out) < most):
            _, node = heapq.heappop(queue)
            if not len(self.children[node]):
                out.append(self.leaf[node])
                continue
            near = self.centres[self.children[node]] @ query
            for child, score in zip(self.children[node], near):
                heapq.heappush(queue, (-float(score), int(child)))
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def distinct_vectors(v: DataFrame, keep: int, salts: int = 16) -> DataFrame:
    """(ids, v): each different vector with its ``keep`` smallest ids; salted, so that no task gets all copies of one."""
    first = Window.partitionBy("v", "salt").orderBy("vec_id")
    then = Window.partitionBy("v").orderBy("vec_id")
    few = (v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).dropDuplicates(["vec_id", "v"])
           .withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep)
           .withColumn("r", F.row_number().over(then)).where(F.col("r") <= keep))
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _top(query_ids, queries, ids, rows, k):
    """For each query its k nearest of the rows, as (query_id, vec_id, score); ``ids`` has the ids of each row."""
    norms = np.linalg.norm(rows, axis=1)
    found: list[tuple] = []
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        scores = (part @ rows.T) / np.linalg.norm(part, axis=1)[:, None] / norms
        for q, s in zip(query_ids[start : start + 256], scores):
            # A row's copies share its score: k + 1 rows hold the k nearest even if the query is one; ties at the end stay.
            cut = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
            best = [(-s[i], v) for i in np.flatnonzero(s >= cut) for v in ids[i] if v != q]
            found += [(q, v, -n) for n, v in heapq.nsmallest(k, best)]
    return found


def _hits(found) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, target_recall: float = 0.95, fit_rows: int = 20_000, most_fit_rows: int = 200_000, leaf_rows: int = 64,
            calibration: int = 200, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row of ``queries`` among ``vectors``."""
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vector_col)
    size = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not size:
        return spark.createDataFrame([], RESULT)
    dim = size[0]["d"]
    kept = stored(distinct_vectors(every.where(F.size("v") == dim), k + 1), "vectors")
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim).dropDuplicates(["vec_id"])
    n = kept.count()
    fit_rows = max(fit_rows, min(most_fit_rows, n // 8))
    sample = least_hashes(kept, F.col("ids")[0], fit_rows, n).select("v").toPandas()
    tree = spark.sparkContext.broadcast(KMeansTree(unit(np.array(sample["v"].tolist(), float)), leaf_rows=leaf_rows))

    def leaves(parts):
        for p in parts:
            if len(p):
                yield p.assign(leaf=tree.value.assign(unit(np.array(p["v"].tolist(), float))))

    placed = stored(kept.mapInPandas(leaves, "v array<double>, ids array<long>, leaf long"), "placed-vectors")

    # Calibration: exact neighbours of a bounded set of queries, each by the place of its leaf in the query's order.
    trial = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).toPandas()
    if not len(trial):
        return spark.createDataFrame([], RESULT)
    trial_ids, trial_rows = trial["vec_id"].tolist(), np.array(trial["v"].tolist(), float)

    def exact(parts):
        for p in parts:
            if len(p):
                found = _hits(_top(trial_ids, trial_rows, p["ids"].tolist(), np.array(p["v"].tolist(), float), k))
                leaf = {v: n for ids, n in zip(p["ids"], p["leaf"]) for v in ids}
                yield found.assign(leaf=found["vec_id"].map(leaf).astype("int64"))

    true = _ranked(placed.mapInPandas(exact, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").toPandas()
    places = {q: {leaf: n for n, leaf in enumerate(tree.value.visits(r))} for q, r in zip(trial_ids, unit(trial_rows))}
    needed = np.sort([places[q][leaf] + 1 for q, leaf in zip(true["query_id"], true["leaf"])])
    width = int(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))) - 1)]) if len(needed) else 1

    def walk(parts):
        for p in parts:
            if len(p):
                yield p.assign(leaf=[tree.value.visits(q, width) for q in unit(np.array(p["v"].tolist(), float))])

    visiting = stored(asked.mapInPandas(walk, "vec_id long, v array<double>, leaf array<long>").select("vec_id", "v", F.explode("leaf").alias("leaf")), "visits")
    # Every block of a leaf's vectors meets every block of its queries. There is one row per leaf, most_fit_rows at most.
    count = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))
    blocks = F.broadcast(count(placed, "blocks").join(count(visiting, "q_blocks"), "leaf"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = placed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks"))).select("leaf", "block", "ids", "v", every("q_blocks").alias("q_block"))
    visiting = visiting.join(blocks, "leaf").withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.col("q_blocks"))).select("leaf", "q_block", "vec_id", "v", every("blocks").alias("block"))

    def search(left, right):
        if not len(left) or not len(right):
            return _hits([])
        return _hits(_top(left["vec_id"].tolist(), np.array(left["v"].tolist(), float), right["ids"].tolist(), np.array(right["v"].tolist(), float), k))

    both = ["leaf", "block", "q_block"]
    hits = visiting.groupBy(*both).cogroup(dealt.groupBy(*both)).applyInPandas(search, "query_id long, vec_id long, score double")
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
