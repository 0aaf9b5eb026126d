"""What tasks hold and shuffles carry must not grow with more than the rows that need it."""

from __future__ import annotations

import collections
import time

import corpus_pipeline
import pytest
from lexspark.llm import alignment, parity_join, queries, shared
from lexspark.llm.chunks import ChunkCache
from pyspark.sql import functions as F
from tests.llm.test_operators import jaccard_brute


def test_rows_that_stay_are_not_shuffled(spark):
    """Of one_of_each only rows that go or stand repeatedly are looked up; copies and repeats are still told apart."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    rows += [(100, rows[0][1]), (1, rows[1][1]), (101, ""), (101, "")]
    found = parity_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "LeftAnti, BuildRight" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.doc_id, r.text) for r in found.collect())) == sorted([*rows[:40], (101, ""), (101, "")])


def test_blocks_of_a_task_are_few(spark):
    """More blocks of documents give more tasks, and files of few blocks."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    files = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECES)
    found = alignment.alignment_digests(docs, *files, block_bytes=1)
    assert found.rdd.getNumPartitions() >= 200 / 8 and found.count() == 200


def test_full_cache_keeps_what_is_asked_again():
    computed = []
    cache = ChunkCache(lambda words: [computed.append(w) or w.upper() for w in words], limit=2)
    assert [cache.values(words) for words in (["a", "b", "c"], ["a", "d"], ["a", "b", "d"])] == [["A", "B", "C"], ["A", "D"], ["A", "B", "D"]]
    assert computed == ["a", "b", "c", "d", "b"] and sorted(cache.known) == ["a", "b", "d"]


def names_in(folder):
    return {p.name.rpartition("-")[0] for p in folder.iterdir() if not p.name.startswith(".")}


def own_folder(spark, monkeypatch, tmp_path):
    """From now on tables are stored in a folder of the test's own."""
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def texts_that_share_a_passage(n=60):
    """Texts that have a passage of 60 words of 200 in common, and four near copies of one; no other pair is near."""
    passage = [f"passage{j}" for j in range(60)]
    rows = [(k, " ".join([f"own{k}x{j}" for j in range(140)] + passage)) for k in range(n)]
    return rows + [(n + k, rows[7][1] + f" other{k}") for k in range(4)]


def test_exact_sets_are_made_of_few(spark, monkeypatch):
    """Texts that share a passage share blocks, but their sketches tell that no pair of them is near: no sets are made of them."""
    rows, made = texts_that_share_a_passage(), []
    keep = parity_join.stored
    monkeypatch.setattr(parity_join, "stored", lambda df, name, *a: (table := keep(df, name, *a), made.append((name, table.count())))[0])
    found = {r.doc_id: r.component_id for r in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert found == {k: 7 if k >= 60 else k for k in range(64)}
    assert dict(made)["classes"] > 40 and max(n for name, n in made if name == "sets") <= 10


@pytest.mark.parametrize("few, chunk", [(8, 256), (1, 256), (1, 3)])
def test_links_within_groups(spark, monkeypatch, few, chunk):
    """Chains of near copies that share a passage with others: pairs of small groups, of large ones and of chunks of these."""
    monkeypatch.setattr(parity_join, "FEW", few)
    monkeypatch.setattr(parity_join, "CHUNK", chunk)
    monkeypatch.setattr(parity_join, "BATCH", 16)
    passage = [f"passage{j}" for j in range(25)]
    rows = []
    for family in range(6):
        words = [f"own{family}x{j}" for j in range(60)]
        for step in range(8):  # each is near the one before it, and not near those further back
            rows.append((len(rows), " ".join(words + passage)))
            words = words[3:] + [f"more{family}x{step}x{j}" for j in range(3)]
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert found == collections.Counter(jaccard_brute(rows, 5, 80)) and len({c for _, _, c in found}) == 6


def test_split_by_keys(spark):
    """All rows that may be a key are in the first part and nearly no others; no row is lost or repeated, not even without an id."""
    rows = spark.createDataFrame([(i % 1990 if i % 200 else None, i, str(i)) for i in range(2000)], "doc_id long, th long, text string")
    keys = rows.where("th % 100 < 3").select("doc_id", "th")
    perhaps, others = shared.split_by_keys(rows, ["doc_id", "th"], keys)
    assert sorted(perhaps.union(others).collect(), key=str) == sorted(rows.collect(), key=str)
    assert {r.th for r in keys.collect()} <= {r.th for r in perhaps.collect()} and perhaps.count() < 70
    assert shared.split_by_keys(rows, ["doc_id", "th"], keys.limit(0))[0].count() == 0


def test_shuffles_go_with_their_query(spark, monkeypatch, tmp_path):
    own_folder(spark, monkeypatch, tmp_path)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, setting = shuffles(), spark.conf.get(shared.SHUFFLES_GO, None)
    table = shared.stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    ends = time.time() + 30
    while shuffles() - before and time.time() < ends:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 700 and spark.conf.get(shared.SHUFFLES_GO, None) == setting


def test_tables_between_steps_go(spark, sf_dir, monkeypatch, tmp_path):
    """What is stored on the way is deleted when it has been read for the last time."""
    home = own_folder(spark, monkeypatch, tmp_path)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    kept = names_in(home)
    assert "n-gram-Jaccard-join" in kept
    assert not kept & {"quality-rules", "line-dedup", "signatures", "shared-blocks", "led-groups", "rooted-groups", "open-groups", "classes", "sets"}
