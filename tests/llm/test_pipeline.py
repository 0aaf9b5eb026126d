from __future__ import annotations

import collections

import corpus_pipeline
import numpy as np
from lexspark.llm.queries import BYTE_BPE, tokenizer_path
from tests.llm.test_operators import jaccard_brute, line_dedup_brute, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, runs long"


def rows_of():
    """Prose with a shared passage, exact and near copies, short, empty and null texts, equal rows and no doc_id."""
    rng = np.random.default_rng(11)
    stock = [f"word{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(stock, n))
    texts = [f"{prose(60)}\n{prose(70)}" for _ in range(12)]
    passage = "\n".join(prose(20) for _ in range(3))
    texts += [f"{prose(90)}\n{passage}\n{prose(30)}" for _ in range(4)]
    near = prose(200).split()
    texts += [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (50, 100, 150)]
    rows = list(enumerate(texts)) + [(100, texts[3]), (101, None), (102, ""), (103, " \n\t"), (104, "too short"), (105, texts[5].replace(" ", "  ")), (106, prose(30_000))]
    return rows + [(107, prose(140))] * 2 + [(None, prose(120))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "r", 1) for i, t in rows], SCHEMA).repartition(3)


def test_stages_against_brute_force(spark, sf_dir):
    docs = frame(spark, rows_of())
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    of = lambda df: {r.doc_id: r.text for r in df.collect()}
    first = of(kept)
    assert not {101, 102, 103, 104} & set(first) and {0, 12, 15, 100} <= set(first)

    unique = kept.where("doc_id is not null and doc_id <> 107").cache()
    second = corpus_pipeline.line_deduplication(spark, unique, sf_dir).cache()
    expected = {i: t for i, t in line_dedup_brute(list(of(unique).items())).items() if words(t)}
    assert of(second) == expected and second.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = corpus_pipeline.near_duplicate_join(spark, second, sf_dir)
    groups = jaccard_brute(list(expected.items()), 5, 80)
    assert set(of(third)) == {c for _, n, c in groups if n} and 17 not in of(third)
    assert collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicate_join(spark, kept, sf_dir).collect())[107] == 1


def test_run(spark, sf_dir, tmp_path):
    """The whole pipeline over its own tables: every kept document's ids, each once."""
    from tokenizers import Tokenizer

    frame(spark, rows_of()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    expected = collections.Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == collections.Counter({i: sum(n * k for (j, n), k in expected.items() if j == i) for i, _ in expected})


def test_empty(spark, sf_dir):
    docs = frame(spark, rows_of()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    total = lambda p: sorted((r.doc_id, r["sum(length)"]) for r in p.groupBy("doc_id").sum("length").collect())
    assert total(corpus_pipeline.run(spark, sf_dir)) == total(pieces)
