"""Cross-references: lists, ranges, languages, merging, selection of spans and links."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from lexspark.functions import languages
from lexspark.operators import crossrefs


def brief(text, lang="EN"):
    return [(s.kind, s.target, s.paragraph, s.point, s.article) for s in crossrefs.found(text, lang)]


def articles(*targets):
    return [("article", t, None, None, None) for t in targets]


@pytest.mark.parametrize("text, expected", [
    ("Articles 6, 7 and 9", articles("6", "7", "9")), ("Article 12a", articles("12a")), ("Articles 5 and 8", articles("5", "6", "7", "8")), ("articles 9 to 8", articles("9")), ("Articles 1 to 52", articles("1")),
    ("Article 6(1)(a) and Article 6(1)(a)", [("article", "6", "1", "a", None)]), ("recitals (3) to (5)", [("recital", x, None, None, None) for x in "345"]), ("Recital 2000 to 999999999", [("recital", "2000", None, None, None)]),
    ("Article 5 of Directive 95/46/EC", [("external", "95/46/EC", None, None, "5")]), ("Article 5 of  the Directive 95/46", [*articles("5"), ("external", "95/46", None, None, None)]),
    ("Articles 5 and 6 of Regulation (EU) No 11/2003", [*articles("6"), ("external", "11/2003", None, None, "5")]),
    ("Article 1 of Article 2 of Decision 77/2010", [*articles("1"), ("external", "77/2010", None, None, "2")]), ("", []), ("Particle 5, Articleship 6", []),
])
def test_found(text, expected):
    assert brief(text) == expected


def test_parts_of_an_act():
    (s,) = crossrefs.found("Article 4(2)(b) of Directive 95/46/EC", "EN")
    assert (s.act_type, s.year, s.number, s.suffix, s.paragraph, s.point, s.start, s.end) == ("directive", "1995", "46", "EC", "2", "b", 0, 37)
    assert [(s.year, s.number) for s in crossrefs.found("Regulation 300/2008, Decision 123/45", "EN")] == [("2008", "300"), (None, None)]


def test_every_language():
    for lang, words in languages.WORDS.items():
        word = words[0].replace("[łl]", "ł").replace("[ií]", "í").replace("[aá]", "á").replace("l?", "l")
        text = "12a. cikk" if lang == "HU" else f"{word} 12a"
        assert brief(text, lang)[:1] == articles("12a"), lang
    assert brief("Artikel 3 der Verordnung 55/2001", "DE") == [("external", "55/2001", None, None, "3")]
    assert brief("Άρθρο 3, αιτιολογική σκέψη 4", "EL") == [*articles("3"), ("recital", "4", None, None, None)]


def merged_brute(text, own, others):
    free, left, joined = list(others), [], []
    for a in own:
        hit = next((e for e in free if e.start >= a.end and text[a.end : e.start].strip() == "of" and text[a.end].isspace() and text[e.start - 1].isspace()), None)
        if hit is None:
            left.append(a)
        else:
            free.remove(hit)
            joined.append((hit.target, a.target))
    return left, free, joined


def test_merging_is_one_to_one():
    rng = np.random.default_rng(3)
    bits = ["Article 5", "Articles 1 to 3", "of", "Directive 95/46", "Decision 77/2010", "and", "of the", "  "]
    for _ in range(400):
        text = " ".join(rng.choice(bits, rng.integers(1, 12)))
        own, others = list(crossrefs.articles(text, "EN")), list(crossrefs.acts(text))
        left, free, joined = merged_brute(text, own, others)
        got = crossrefs.merged(text, own, others, "EN")
        assert [s for s in got if s.kind == "article"] == left
        assert [(s.target, s.article) for s in got if s.article] == joined and sorted(s.target for s in got if s.kind == "external" and not s.article) == sorted(s.target for s in free)


def longest_brute(spans):
    kept, cursor = [], None
    left = list(spans)
    while left:
        best = min(left, key=lambda s: (s[2], -s[3], s[1]))
        if cursor is None or best[2] >= cursor:
            kept.append(best)
            cursor = best[3]
        left.remove(best)
    return kept


def test_longest_spans(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), i, int(s), int(s + n)) for i, (k, s, n) in enumerate(zip(rng.integers(0, 30, 900), rng.integers(0, 60, 900), rng.integers(0, 9, 900)))]
    odd = [(None, 1, 0, 5), (5, 2000, None, 5), (5, 2001, 5, None)]
    table = spark.createDataFrame(rows + odd, "text long, ordinal long, start long, end long").repartition(5)
    expected = {s for _, own in itertools.groupby(sorted(rows), lambda r: r[0]) for s in longest_brute(list(own))}
    got = [tuple(r) for r in crossrefs.longest_spans(table, "text").collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert crossrefs.longest_spans(table.limit(0), "text").count() == 0


def test_links():
    assert crossrefs.with_links("<p>See Article 5(1).</p>", "EN") == '<p>See <a class="cross-ref" data-ref-article="5" href="#article-5" title="Go to Article 5">Article 5(1)</a>.</p>'
    whole = crossrefs.with_links("<p>Article 5 of Regulation (EU) 2016/679</p>", "EN")
    assert whole.count("<a ") == 1 and 'class="external-ref"' in whole and 'data-ref-article="5"' in whole and 'data-ref-act-type="regulation"' in whole
    twice = crossrefs.with_links('<p><a class="cross-ref" href="#article-5">Article 5</a> and Article 6</p>', "EN")
    assert twice.count('class="cross-ref"') == 2
    for untouched in ("", "<p>no reference &amp; more</p>", '<span class="defined-term">Article 5</span>', "<a><br><b>Article 5</b></a>", "</b></a>x", "<"):
        assert crossrefs.with_links(untouched, "EN") == untouched
    assert crossrefs.with_links("<a>Article 5</a></a> Article 6", "EN").count("cross-ref") == 1
    assert crossrefs.with_links("Artikel 5 &lt; ü", "DE").endswith("</a> &lt; ü")


def test_columns(spark):
    rows = [(1, "Article 5", "EN"), (2, None, "EN"), (3, "", "XX"), (4, "Artikel 5", "de"), (4, "Artikel 5", "de"), (None, "Article 7", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.ordinal, r.target, r.raw) for r in crossrefs.extracted(table, ["doc_id"]).collect())
    assert got == [(0, 1, "7", "Article 7"), (1, 1, "5", "Article 5"), (4, 1, "5", "Artikel 5"), (4, 1, "5", "Artikel 5")]
    assert table.select(crossrefs.linked("text", "lang").alias("t")).where("t like '%cross-ref%'").count() == 4


@pytest.mark.parametrize("text", ["Article 5, " * 60_000, "Articles 1" + ", 2" * 200_000, "of " * 200_000, "<b>" * 100_000 + "Article 5", "</b>" * 100_000, "<i></b>" * 50_000])
def test_long_texts(text):
    start = time.process_time()
    crossrefs.found(text, "EN")
    crossrefs.with_links(text, "EN")
    assert time.process_time() - start < 10
