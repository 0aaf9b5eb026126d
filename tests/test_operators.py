"""Operators without SQL, against small cases and brute force."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lexspark import catalogue
from lexspark.functions import text
from lexspark.operators import citations, search, tfidf, usage
from lexspark.sources import adapters, flat_laws, formex, judgments
from lexspark.streaming import usage as streams

ACT = """<ACT><PREAMBLE><GR.CONSID><CONSID><NP><NO.P>(1)</NO.P><TXT>Whereas <HT TYPE="ITALIC">this</HT> holds.</TXT></NP></CONSID>
<CONSID><NP><TXT>No number.</TXT></NP></CONSID></GR.CONSID></PREAMBLE><ENACTING.TERMS>
<DIVISION><TITLE><TI><P>CHAPTER I</P></TI><STI><P>General</P></STI></TITLE>
 <ARTICLE IDENTIFIER="001"><TI.ART>Article 1</TI.ART><STI.ART><P>Definitions</P></STI.ART><ALINEA><LIST><ITEM><NP><TXT><QUOT.START/>user<QUOT.END/> means a person;</TXT></NP></ITEM></LIST></ALINEA></ARTICLE>
 <DIVISION><TITLE><TI><P>SECTION 1</P></TI></TITLE><ARTICLE IDENTIFIER="002A"><TI.ART>Art. two</TI.ART><ALINEA>Text</ALINEA></ARTICLE></DIVISION></DIVISION>
<DIVISION><TITLE><TI><P>CHAPTER II</P></TI></TITLE><ARTICLE><TI.ART>Article 6a</TI.ART><ALINEA>More</ALINEA></ARTICLE></DIVISION>
</ENACTING.TERMS><ANNEX><TITLE><TI><P>ANNEX IV</P></TI></TITLE><CONTENTS><P>Table</P></CONTENTS></ANNEX></ACT>"""


def test_formex(spark):
    acts = spark.createDataFrame([(1, ACT), (2, "<ACT><broken"), (3, None)], "doc_id long, xml string")
    rows = {(r.doc_id, r.kind, r.ordinal): r for r in formex.parsed(acts).collect()}
    assert len(rows) == 8
    assert rows[1, "recital", 1].text == "Whereas this holds." and [rows[1, "recital", k].number for k in (1, 2)] == ["1", "2"]
    assert [(rows[1, "article", k].number, rows[1, "article", k].chapter, rows[1, "article", k].section) for k in (1, 2, 3)] == [("1", "CHAPTER I — General", None), ("2A", "CHAPTER I — General", "SECTION 1"), ("6a", "CHAPTER II", None)]
    assert (rows[1, "definition", 1].title, rows[1, "definition", 1].text) == ("user", "a person")
    assert (rows[1, "annex", 1].number, rows[1, "annex", 1].text) == ("IV", "Table")
    assert rows[2, "error", 0].error
    assert formex.parsed(acts.limit(0)).count() == 0


RECORDS = [
    ("32016R0679", "Regulation on the protection of natural persons (General Data Protection Regulation)", "reg/2016/679"), ("32022R0868", "Regulation on European data governance (Data Governance Act)", "reg/2022/868"),
    ("32022R1925", "Regulation on contestable and fair markets in the digital sector (Digital Markets Act)", "reg/2022/1925"), ("32022R2065", "Regulation on a Single Market For Digital Services (Digital Services Act)", "reg/2022/2065"),
    ("32023R2854", "Regulation on harmonised rules on fair access to and use of data (Data Act)", "reg/2023/2854"), ("32000L0031", "Directive on electronic commerce", "dir/2000/31"),
    ("32002L0058", "Directive on privacy and electronic communications", "dir/2002/58"), ("32015L2366", "Directive on payment services in the internal market", "dir/2015/2366"),
]


@pytest.mark.parametrize(
    ("query", "celex"),
    [("32016R0679", "32016R0679"), ("regulation 2016/679", "32016R0679"), ("digital markets act", "32022R1925"), ("digital services act", "32022R2065"), ("data act", "32023R2854"),
     ("data governance act", "32022R0868"), ("ecommerce", "32000L0031"), ("eprivacy", "32002L0058"), ("payment services directive", "32015L2366")],
)
def test_first_found_act(spark, query, celex):
    kinds = {"R": "regulation", "L": "directive"}
    rows = [(k, c, t, kinds[c[5]], f"{c[1:5]}-01-01", f"http://data.europa.eu/eli/{e}/oj") for k, (c, t, e) in enumerate(RECORDS)]
    records = spark.createDataFrame(rows, "ord long, celex string, title string, type string, date string, eli string")
    assert search.law_search(records, query, 1, rewrite=False).first().celex == celex


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def test_answers_of_the_search(spark):
    """Aliases, match reasons and queries with marks."""
    rows = [(0, "32022R1925", "Regulation on markets (Digital Markets Act)", "regulation", "2022-01-01", "http://x/eli/reg/2022/1925/oj"), (1, "32016L0679", "CORRELATION TABLE", "directive", "2016-01-01", "http://x/eli/dec_impl/2016/679/oj")]
    records = spark.createDataFrame(rows, "ord long, celex string, title string, type string, date string, eli string")
    found = {r.ord: r for r in search.enriched(records).collect()}
    assert {"regulation", "dma", "digital markets act", "digitalmarketsact", "32022r1925", "regulation 32022r1925"} <= set(found[0].aliases)
    assert found[1].title is None and found[1].kind == "other" and not found[1].is_primary
    reason = lambda q: {r.ord: r.r for r in search.enriched(records).select("ord", search.match_reason(search.parsed_query(q, False)).alias("r")).collect()}
    assert reason("2016/679")[1] == "token_match" and reason("directive 2016/679")[1] == "reference_exact" and reason("digital markets")[0] == "title_phrase"
    assert search.plain("Protección de datos") == "proteccion de datos"
    assert [r.celex for r in search.law_search(records, "directive 2016/679").collect()] == ["32022R1925"]  # the other is no primary act


def test_citation_forms(spark):
    said = {"Article 6(1) of the gdpr": "Art. 6(1) GDPR", "Article 6(1) of Regulation (EU) 2016/679 on data": "Art. 6(1) GDPR", "Articles 7 and 8 of the charter, read": "Art. 7 and 8 Charter", "Article 4 of Directive 95/46/EC": "Art. 4 95/46", "Article 267 TFEU": "Article 267 TFEU".replace("Article", "Art.")}
    for text, pill in said.items():
        assert one(spark, c=text).select(citations.pill(F.col("c")).alias("p")).first().p == pill
    rows = citations.structured(one(spark, k="a", pill="Art. 6, 6(1)(a), 6 and 7 GDPR"), ["k"]).orderBy("at").collect()
    assert [(r.article, r.paragraph, r.point, r.act_celex) for r in rows] == [("6", None, None, "32016R0679"), ("6", "1", "a", "32016R0679"), ("7", None, None, "32016R0679")]
    wide = spark.createDataFrame([("a", 1, 3), ("b", 1, 99), ("c", 5, 2)], "src string, first long, last long")
    assert sorted((r.src, r.article) for r in citations.expanded_ranges(wide).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 5)]


def test_content_search(spark):
    docs = spark.createDataFrame([(1, "privacy of data subjects", "Privacy"), (2, "markets and privacy", "Markets"), (3, "fishing quotas", "Fish"), (4, "", "")], "doc_id long, text string, title string")
    assert [r.doc_id for r in tfidf.content_search(docs, "privacy").collect()] == [1, 2]
    assert [r.doc_id for r in tfidf.content_search(docs, "of").collect()] == [1]  # no usable token: documents that contain it
    assert [(r.doc_id, r.score) for r in tfidf.content_search(docs, "3").collect()] == []
    assert tfidf.content_search(docs, "fishing").first().score == pytest.approx(100 * 2**-0.5, abs=1e-5)


def test_stopwords_are_counted_once():
    assert len(text.STOPWORDS_EN) == len(set(text.STOPWORDS_EN)) == 158


def test_deep_documents(spark):
    deep = "<ACT><ENACTING.TERMS><ARTICLE><TI.ART>Article 1</TI.ART>" + "<P>" * 5000 + "x" + "</P>" * 5000 + "</ARTICLE></ENACTING.TERMS></ACT>"
    rows = formex.parsed(spark.createDataFrame([(1, deep)], "doc_id long, xml string")).collect()
    assert [(r.kind, r.text) for r in rows] == [("article", "x")]


def places(rows, seconds=900):
    """Per client, in order: a window starts with its first request and holds those up to its end."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        start, n = state.get(r.ip, (None, 0))
        if start is None or r.ts - start > timedelta(seconds=seconds):
            start, n = r.ts, 0
        state[r.ip] = start, n + 1
        out[r.id] = n + 1
    return out


def test_rate_limits(spark, sf_dir):
    requests = adapters.requests(spark, sf_dir).selectExpr("id", "ts", "regexp_replace(ip, '[.][0-9]+$', '.0') as ip")
    expected = places(requests.collect())
    for name in ("rate_limit", "stream_rate_limit"):
        got = {r.id: (r.place, r.allowed) for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
        assert got == {k: (p, p <= 100) for k, p in expected.items()}


def test_rate_limits_of_a_large_client(spark, tmp_path):
    """25,000 requests, nearly all of one client, out of order."""
    log = spark.range(25_000).selectExpr("id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 25000) as ts", "if(id % 5000 = 0, '10.0.1.0', '10.0.0.0') as ip")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    expected = {k: (p, p <= 100) for k, p in places(log.collect()).items()}
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    for got in (usage.rate_limited(log), streams.drained(streams.rate_limited(stream), "large-client")):
        assert {r.id: (r.place, r.allowed) for r in got.collect()} == expected


def test_closed_days(spark, sf_dir):
    batch = {r.day: r.n_requests for r in catalogue.QUERIES["daily_usage"](spark, sf_dir).collect()}
    closed = {r.day: r.n_requests for r in catalogue.QUERIES["stream_daily"](spark, sf_dir).collect()}
    assert closed and closed.items() <= batch.items() and len(batch) - len(closed) <= 2


def test_closed_days_count_addresses(spark, tmp_path):
    """Closed days equal the batch report, where addresses are many and users few; no day is closed before its watermark."""
    days = spark.range(20_000).selectExpr("id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 4, 0, 0, id % 86400) as ts", "id % 7 as user_id", "if(id % 100 = 0, null, concat('10.', id % 4000, '.0')) as ip")
    days.repartition(3).write.parquet(str(tmp_path / "log"))
    expected = {tuple(r) for r in usage.daily(days).collect()}
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "log"))
    assert streams.drained(streams.daily_counts(stream, "10 days"), "open-days").count() == 0
    got = [tuple(r) for r in streams.drained(streams.daily_counts(stream), "days").collect()]
    assert len(got) == len(set(got)) >= 2 and set(got) <= expected


@pytest.mark.parametrize("name", catalogue.WITHOUT_SQL)
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_judgments(spark):
    ruling = '<p class="coj-normal">On those grounds, the Court (Grand Chamber) hereby rules:</p>'
    point = '<table><tr><td><p class="coj-count coj-bold">1.</p></td><td><p>One</p></td></tr></table>'
    pages = {
        1: ruling + point + '<table><tr><td><p class="coj-normal">Delivered in open court</p></td></tr></table>',
        2: ruling + '<table><tr><td>no number</td></tr></table><dt>4</dt><dd> four</dd>',  # falls to the terms
        3: "On those grounds, THE COURT hereby orders: costs in 1. Language of the case: English",
        4: "<p>On those grounds, the Court (Chamber) hereby declares 1. A 2.  B 10. C 3.</p>",
        5: '<p class="C08Dispositif">&nbsp;</p><p class="C08DispositifX">5.x</p><p class="C08Dispositif">6.</p>',
        6: "", 7: None, 8: "<p", 9: "On those grounds, THE COURT rules: Delivered in open court",
    }
    table = spark.createDataFrame(list(pages.items()), "doc_id long, html string")
    found = [(r.doc_id, r.ordinal, r.number, r.text) for r in judgments.declarations(table).collect()]
    assert sorted(found) == [
        (1, 1, 1, "One"), (2, 1, 4, "4 four"), (3, 1, 1, "costs in 1."), (4, 1, 1, "A"), (4, 2, 2, "B"), (4, 3, 10, "C 3."),
        (5, 1, 5, "x"), (5, 2, 2, "6."),
    ]
    about = {r.doc_id: r for r in judgments.metadata(table).collect()}
    assert len(about) == 9 and all(v is None for r in about.values() for v in r[1:])
    assert judgments.declarations(table.limit(0)).count() == 0


def test_flat_law(spark):
    law = ["Council Regulation", "TITLE IX", "Whereas:", "intro", "(1) First", "goes on;", "(2)Second", "Article 1", "Definitions", '(a) "user" means a person;', "(b) the tool means any tool",
           "(1) not a recital", "CHAPTER II", "GENERAL RULES", "SECTION 1 Scope", "Article 2A", "Text.", "IN CAPITALS", "Late title", "CHAPTER III", "Article 3"]
    page = lambda ps: "".join(f"<p>{p}</p>" for p in ps)
    pages = {1: page(law), 2: page(law[4:8]), 3: "", 4: None, 5: "<p>", 6: page(law[:7])}
    lines = flat_laws.paragraphs(spark.createDataFrame(list(pages.items()), "doc_id long, html string")).cache()
    assert lines.where("doc_id = 1").count() == len(law) and lines.where("doc_id in (3, 4, 5)").count() == 0
    found = flat_laws.articles(lines)
    assert sorted(map(tuple, found.collect())) == [
        (1, 1, "1", "Definitions", None, None, ['(a) "user" means a person;', "(b) the tool means any tool", "(1) not a recital"]),
        (1, 2, "2A", "Late title", "CHAPTER II — GENERAL RULES", "SECTION 1 — Scope", ["Text.", "IN CAPITALS"]),
        (1, 3, "3", None, "CHAPTER III", None, []), (2, 1, "1", None, None, None, []),
    ]
    assert sorted((r.term, r.definition) for r in flat_laws.definitions(found).collect()) == [("the tool", "any tool"), ("user", "a person")]
    assert sorted(map(tuple, flat_laws.recitals(lines).collect())) == [(1, 1, "1", "First goes on;"), (1, 2, "2", "Second")]
    assert flat_laws.articles(lines.limit(0)).count() == flat_laws.recitals(lines.limit(0)).count() == 0


def test_tooltips(spark):
    """Spans of the law's own terms; nulls stay, empty terms do nothing, inflected words are found by their stems."""
    from lexspark.operators.tooltips import with_tooltips

    units = spark.createDataFrame([(1, "<p>Danych osobowych</p>"), (2, None), (3, "<b>data</b>"), (4, "x (y) data")], "doc_id long, html string")
    terms = [(1, 1, "dane osobowe", None), (2, 1, "data", "d"), (3, 1, "", "d"), (3, 2, None, "d"), (4, 1, "(y)", "<d>")]
    definitions = spark.createDataFrame(terms, "doc_id long, place int, term string, definition string")
    span = '<span class="defined-term" data-definition="{0}" title="{0}">{1}</span>'
    stems = {r.doc_id: r.html for r in with_tooltips(units, definitions, inflected=True).collect()}
    assert stems[1] == f"<p>{span.format('', 'Danych osobowych')}</p>" and stems[2] is None and stems[3] == "<b>data</b>"
    whole = {r.doc_id: r.html for r in with_tooltips(units, definitions).collect()}
    assert whole[1] == "<p>Danych osobowych</p>" and whole[4] == f"x {span.format('&lt;d&gt;', '(y)')} data"


def test_proposals(spark):
    """Headings before the enacting formula don't count; a division ends an article; null and empty pages give nothing."""
    from lexspark.sources import proposals

    page = (
        '<p class="SectionTitle">TITLE X</p><p class="li ManualConsidrant"><span class="num">(2)</span> B</p><p class="li ManualConsidrant">A</p>'
        '<p class="Formuledadoption">HAVE ADOPTED</p><p class="SectionTitle">CHAPTER I</p><p class="SectionTitle">General</p><p class="SectionTitle">More</p>'
        '<p class="Titrearticle">Article 1</p><p>One</p><p class="SectionTitle">SECTION 2</p><p>lost</p><p class="Titrearticle">Article 2 Scope</p>'
        '<p class="Annexetitre">ANNEX</p><p>Two</p><p class="SectionTitle">TITLE V</p><p>Three</p>'
    )
    rows = proposals.parsed(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p></p>")], "doc_id long, html string")).collect()
    found = {(r.kind, r.ordinal): (r.number, r.title, r.chapter, r.section, r.text) for r in rows if r.doc_id == 1}
    assert len(rows) == len(found) == 5
    assert found["article", 1] == ("1", "", "CHAPTER I — General", None, "One")
    assert found["article", 2] == ("2", "Scope", "CHAPTER I — General", "SECTION 2", "")
    assert found["annex", 1] == ("ANNEX", "ANNEX", None, None, "Two\nThree")
    # Both have the number 2, one of them by its place; the earlier one comes first.
    assert [found["recital", k][::4] for k in (1, 2)] == [("2", "B"), ("2", "A")]
