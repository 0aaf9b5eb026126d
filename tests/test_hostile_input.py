"""Input that once ended jobs or took minutes."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.sources import judgments

col = F.col


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("out")).first().out


@pytest.mark.parametrize("written, plain", [
    ("&#9999999;", "&#9999999;"), ("&#x00000041;&#0000000066;", "AB"), ("&#xD83D;&#xDE00; &#55357;&#56832;", "😀 😀"), ("&#xD83D;x", "�x"), ("&#x110000;&#x10FFFF;", "&#x110000;\U0010ffff"),
    ("&#0;&#" + "9" * 400 + ";", "\x00&#" + "9" * 400 + ";"), ("&amp;#65;&Hellip;&lt;", "&#65;...<"), ("", ""), (None, None),
])
def test_references(spark, written, plain):
    assert one(spark, written, text.decoded(col("t"))) == plain


@pytest.mark.parametrize("answer, titles", [
    ('{"1": "a", " 1 ": "b"}', {"1": "b"}), ('{"1": "a", "1": "c", "2": ""}', {"1": "c"}), ("{" + '"a":{' * 5000 + "}" * 5000 + "}", {}), ("[1]", {}), ('{"1": 7, "2": null, "9": "x"}', {"1": "7"}), (None, {}), ("", {}),
])
def test_titles_by_key(spark, answer, titles):
    assert one(spark, answer, text.titles_by_key(col("t"), F.array(F.lit("1"), F.lit("2")))) == titles


def test_nothing_is_cut(spark):
    long = "x" * 1_000_100
    assert one(spark, 'data: {"choices":[{"delta":{"content":"' + long + '"}}]}', text.stream_text(col("t"))) == long
    assert one(spark, " — ".join(f"p{k}" for k in range(1200)), F.length(text.annex_title(col("t"), F.lit("")))) == len(" — ".join(f"p{k}" for k in range(1, 1200)))


GROUNDS = "<p class=\"coj-normal\">On those grounds, the Court (Grand Chamber) hereby rules:</p>"
PAGES = {
    "spaces": f'{GROUNDS}<table><tr><td><p class="coj-count coj-bold">{" " * 300_000}1.</p></td><td><p class="coj-normal">It is so.</p></td></tr></table>',
    "tags": f'{GROUNDS}<table><tr><td><p class="coj-count coj-bold">{"<i> </i>" * 100_000}1.</p></td><td><p class="coj-normal">It is so.</p></td></tr></table>',
    "terms": "hereby rules" + f"<dt>{'&nbsp;' * 150_000}1.</dt><dd>It is so.</dd>",
    "open": '<p class="x ' * 90_000, "count": '<p class="coj-count" ' * 50_000, "courts": "On those grounds, the Court (" * 35_000, "cases": "In Joined Cases C-1/04" + ", C-1/04" * 130_000, "fonts": '<font class="oj-font"><b>x</b>y</font>' * 25_000,
    "titles": '<p class="coj-sum-title-1">' * 35_000, "less": "<" * 900_000,
}


def test_judgments(spark):
    """All pages in one job; each would have taken minutes or ended the JVM."""
    pages = spark.createDataFrame(list(PAGES.items()), "doc_id string, html string").repartition(4)
    start = time.time()
    found = {(r.doc_id, r.number, r.text) for r in judgments.declarations(pages).where("doc_id in ('spaces', 'tags', 'terms')").collect()}
    assert judgments.declarations(pages).count() > 2 and judgments.metadata(pages).count() == len(PAGES)
    assert time.time() - start < 120
    assert found == {(name, 1, "It is so.") for name in ("spaces", "tags", "terms")}
