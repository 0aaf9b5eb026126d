"""Term weights send a document's text on, not its pairs with terms, and give what the plain form gives."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lexspark import catalogue
from lexspark.functions.text import STOPWORDS_EN, tokens


@pytest.mark.parametrize("name", ["tf", "idf", "doc_magnitude", "content_search"])
def test_no_pair_of_document_and_term_is_a_key_of_a_shuffle(spark, sf_dir, name):
    with redirect_stdout(io.StringIO()) as plan:
        catalogue.QUERIES[name](spark, sf_dir).explain()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan.getvalue())
    assert keys and not any("doc_id" in k and "term" in k for k in keys)


def test_tokens_are_found_in_one_pass(spark):
    odd = ["", None, "ab abc  the_x İstanbul", "Àéɏɐabc x-ray,\x0bzzz\x1c\x85qqq \U0001d49c\U0001d49cabc", "union Kelvin Kelvin 12 123"]
    cleaned = F.regexp_replace(F.lower("text"), r"[^\w\sÀ-ɏ]", " ")
    plain = F.filter(F.split(cleaned, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS_EN))
    found = spark.createDataFrame([(x,) for x in odd], "text string").select(tokens(F.col("text")).alias("one"), plain.alias("two"))
    assert all(r.one == r.two for r in found.collect())
    with redirect_stdout(io.StringIO()) as plan:
        found.select("one").explain()
    assert "split(" not in plan.getvalue()


def test_rows_of_one_id_count_as_one_document(spark):
    from lexspark.operators import tfidf

    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma"), (2, "beta delta"), (None, "alpha"), (None, "alpha"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.term, r.tf) for r in tfidf.tf(tfidf.dealt(docs, ["doc_id"]), ["doc_id"]).collect()} == {(1, "alpha", 2), (1, "beta", 1), (1, "gamma", 1), (2, "beta", 1), (2, "delta", 1), (None, "alpha", 2)}
    plain = docs.where("text is not null").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").count()
    df = {r.term: r.n for r in plain.groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert df == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 1}
    import math

    w = {(r.doc_id, r.term): round(r.w, 9) for r in tfidf.weighted(docs, ["doc_id"]).collect()}
    assert w == {(r.doc_id, r.term): round(r["count"] * math.log10(6 / df[r.term]), 9) for r in plain.collect()}
