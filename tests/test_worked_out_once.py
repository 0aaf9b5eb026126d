"""Steps name their input often; plans must not repeat what gives it, and work on few bytes must not be one task's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexspark import catalogue
from lexspark.functions import text
from lexspark.operators import citations
from lexspark.sources import html_laws


@pytest.mark.parametrize("name", ["html_title_pick", "grounded_digests", "grounded_summaries", "entities_decode"])
def test_plans_stay_short(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 60_000, len(plan)


@pytest.mark.parametrize("name", ["html_title_pick", "entities_decode", "judgment_metadata", "judgment_declarations"])
def test_small_tables_are_spread(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() > 1


def test_citation_is_read_once(spark):
    found = citations.structured(spark.range(1).select(F.lit("k").alias("k"), F.concat(F.lit("Art. 6 and 7 GDPR"), F.col("id").substr(1, 0)).alias("pill")), ["k"])
    assert "Filter (size(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.article for r in found.collect()) == ["6", "7"]


def test_references_without_marks(spark):
    rows = spark.createDataFrame([("plain",), ("&#65;&#x42;&amp;lt;",), (None,)], "t string").select(text.decoded(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == ["plain", "AB&lt;", None]


@pytest.mark.parametrize("name", ["recital_links", "recital_keywords"])
def test_units_are_shuffled_once(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange ") == 1


def test_pages_are_shuffled_once(spark, sf_dir):
    """What is read of a page comes from files kept by page; of what is read only definitions are dealt again."""
    plan = catalogue.QUERIES["parse_html_law"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_pages_with_marks_of_several_layouts(spark):
    legacy = '<p class="ti-art">Article 1</p><p class="normal">Aim</p><p class="normal">(a) “thing” means any thing;</p>'
    own = '<div class="eli-subdivision"><p class="oj-ti-art">Article 7</p></div>'
    pages = [(1, '<div class="eli-subdivision"></div>' + legacy.replace("Aim", "Definitions")), (2, own + legacy), (3, '<p class="Titrearticle">Article 3</p>' + legacy), (4, '<div class="eli-subdivision"></div><p>Article 9</p>')]
    rows = html_laws.parsed(spark.createDataFrame(pages, "doc_id long, html string")).collect()
    assert sorted((r.doc_id, r.layout, r.kind, r.number or r.title) for r in rows) == [
        (1, "legacy", "article", "1"), (1, "legacy", "definition", "thing"), (2, "structured", "article", "7"), (3, "legacy", "article", "1"), (3, "legacy", "article", "3"), (4, "flat", "article", "9"),
    ]
