"""Pages of acts in their four layouts, and the walk over hostile pages."""

from __future__ import annotations

import time

import pytest

from lexspark.sources import flat_laws, html_laws, markup, proposals

HEAD = '<!DOCTYPE html>\n<html lang="EN"><head><meta name="DC.description" content="Directive on tests"></head><body>'
FLAT = HEAD + """<div id="TexteOnly"><p><TXT_TE><p>Directive of the Parliament</p><p>of 12 July 2002</p><p>Whereas:</p><p>(1) First reason.</p><p>(2) Second reason, of Article 2.</p>
<p>Article 1</p><p>Scope</p><p>1. This Directive lays down rules.</p><p>Article 2</p><p>Definitions</p><p>The following definitions shall also apply:</p>
<p>(a) "user" means any natural person using a service;</p><p>(b) "traffic data" means any data processed for billing.</p></TXT_TE></p></div></body></html>"""
DIVIDED = HEAD + """<p><TXT_TE><p>Article 4</p><p>National law applicable</p><p>1. Each State shall apply its provisions.</p><p>CHAPTER II GENERAL RULES ON DATA</p><p>Article 5</p>
<p>States shall determine more precisely the conditions.</p><p>SECTION I</p><p>PRINCIPLES OF QUALITY</p><p>Article 6</p><p>1. States shall provide fairly.</p></TXT_TE></p>"""
STRUCTURED = HEAD + """<p class="oj-doc-ti">Directive (EU) 2015/2366</p>
<div class="eli-subdivision" id="rct_2"><table><tr><td>(2)</td><td><p>Second <b>reason</b>.</p></td></tr></table></div>
<div class="eli-subdivision" id="rct_1"><table><tr><td>(1)</td><td>First reason.</td></tr></table></div>
<p class="oj-ti-section-1">CHAPTER I</p><p class="oj-ti-section-2">General</p><p class="oj-ti-section-2">Not taken</p>
<div class="eli-subdivision" id="art_1"><div class="eli-title"><p class="oj-ti-art">Article 1</p><p class="oj-sti-art">Subject matter</p></div><p>This Directive lays down rules.</p>loose text</div>
<p class="title-division-1">SECTION 2</p><p class="title-division-2">Words</p>
<div class="eli-subdivision" id="art_2"><p class="title-article-norm">Article 2a</p><p class="stitle-article-norm">Definitions</p>
<table><tr><td>(1)</td><td>‘user’ means a person; </td></tr></table><table><tr><td>(2)</td><td>no definition</td></tr></table><div class="eli-subdivision" id="x">nested part</div></div>
<p class="oj-ti-section-1">CHAPTER II</p>
<div class="eli-subdivision" id="anx_1"><p class="oj-ti-annex">ANNEX IV</p><p class="oj-ti-annex-2">Forms</p><p>Body of it.</p></div>
<p>ANNEX</p><p class="oj-normal">Untitled</p><p>Last.</p></body></html>"""
PROPOSAL = HEAD + """<p class="Statut"><span>Proposal for a</span></p><p class="Titreobjet">ON A MATTER</p><p class="Normal">Prose that isn't a recital.</p>
<p class="li ManualConsidrant"><span class="num"><span>(1)</span></span><span>First reason.</span></p><p class="li ManualConsidrant"><span class="num">(2)</span>Second reason of Article 2.</p>
<p class="Formuledadoption">HAVE ADOPTED</p><p class="SectionTitle">TITLE I</p><p class="SectionTitle">GENERAL PROVISIONS</p><p class="Titrearticle"><span>Article 1</span><span> <br>Subject matter</span></p><p class="Normal">This lays down rules.</p>
<p class="Titrearticle">Article 2<br>Definitions</p><p>(a) “thing” means any thing;</p><p class="Annexetitre"><span>ANNEX </span><span>I</span><br><span>SAMPLE</span></p><p class="Normal">Annex body.</p></body></html>"""
LEGACY = HEAD + """<p class="doc-ti">COUNCIL DIRECTIVE</p><p class="normal">Whereas travel matters;</p><p class="normal">(5) numbered reason</p><p class="note">Whereas the consumer should be protected;</p><p>Whereas:</p><p class="other">no recital</p>
<p class="normal">CHAPTER I</p><p class="normal">RULES</p><p class="ti-art"><span class="italic">Article 1</span></p><p class="normal">Objective</p><p class="normal">The purpose is to approximate.</p>
<p class="normal">SECTION 1 Own</p><p class="ti-art">Article 2</p><p class="normal">Definitions</p><table><tr><td>(a)</td><td> “organizer” means the person;</td></tr></table>
<p class="doc-ti">ANNEX</p><p class="doc-ti">TERMS REFERRED TO</p><p class="normal">1. Terms excluding liability.</p><p class="doc-ti">ANNEX II</p><p class="normal">Rest.</p></body></html>"""
GERMAN = """<html lang="de"><div class="eli-subdivision" id="a"><p class="oj-ti-section-1">ABSCHNITT 3</p><p class="oj-ti-art">Artikel 7b</p><p>Text.</p></div><p>ANHANG II</p><p>Ende.</p></html>"""
GREEK = """<html lang="el"><p class="oj-ti-section-1">ΤΜΗΜΑ 1</p><div class="eli-subdivision" id="a"><p class="oj-ti-art">Άρθρο 3</p></div></html>"""
THROUGH = HEAD + """<div class="eli-subdivision"><p>Article 1</p><p>Name of it</p><p>Text.</p></div>"""


@pytest.fixture(scope="module")
def units(spark):
    pages = dict(flat=FLAT, divided=DIVIDED, structured=STRUCTURED, proposal=PROPOSAL, legacy=LEGACY, german=GERMAN, greek=GREEK, through=THROUGH, empty="", none="<p>no unit</p>", null=None)
    names = list(pages)
    rows = html_laws.parsed(spark.createDataFrame(list(enumerate(pages.values())), "doc_id long, html string")).collect()
    found = {n: [] for n in names}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.kind, r.ordinal)):
        found[names[r.doc_id]].append((r.layout, r.kind, r.number, r.title, r.chapter, r.section, r.text))
    return found


def test_flat(units):
    assert units["flat"] == [
        ("flat", "article", "1", "Scope", None, None, "1. This Directive lays down rules."),
        ("flat", "article", "2", "Definitions", None, None, 'The following definitions shall also apply:\n(a) "user" means any natural person using a service;\n(b) "traffic data" means any data processed for billing.'),
        ("flat", "definition", None, "user", None, None, "any natural person using a service"),
        ("flat", "definition", None, "traffic data", None, None, "any data processed for billing."),
        ("flat", "recital", "1", None, None, None, "First reason."),
        ("flat", "recital", "2", None, None, None, "Second reason, of Article 2."),
    ]
    assert [u[2:6] for u in units["divided"]] == [("4", "National law applicable", None, None), ("5", None, "CHAPTER II — GENERAL RULES ON DATA", None), ("6", None, "CHAPTER II — GENERAL RULES ON DATA", "SECTION I — PRINCIPLES OF QUALITY")]
    assert units["through"] == [("flat", "article", "1", "Name of it", None, None, "Text.")]
    assert units["empty"] == units["none"] == units["null"] == []


def test_structured(units):
    assert units["structured"] == [
        ("structured", "annex", "IV", "ANNEX IV — Forms", None, None, "Body of it."),
        ("structured", "annex", "ANNEX — Untitled", "ANNEX — Untitled", None, None, "Last."),
        ("structured", "article", "1", "Subject matter", "CHAPTER I — General", None, "This Directive lays down rules.\nloose text"),
        ("structured", "article", "2a", "Definitions", "CHAPTER I — General", "SECTION 2 — Words", "(1)\n‘user’ means a person;\n(2)\nno definition\nnested part"),
        ("structured", "definition", "2a", "user", None, None, "a person;"),
        ("structured", "recital", "1", None, None, None, "First reason."),
        ("structured", "recital", "2", None, None, None, "Second reason."),
    ]


def test_structured_in_other_languages(units):
    assert units["german"] == [("structured", "annex", "II", "ANHANG II", None, None, "Ende."), ("structured", "article", "7b", "", None, "ABSCHNITT 3", "Text.")]
    assert units["greek"] == [("structured", "article", "3", "", None, "ΤΜΗΜΑ 1", "")]


def test_proposal(units):
    assert [u[:4] for u in units["proposal"]] == [
        ("proposal", "annex", "I", "ANNEX I SAMPLE"), ("proposal", "article", "1", "Subject matter"), ("proposal", "article", "2", "Definitions"), ("proposal", "definition", None, "thing"), ("proposal", "recital", "1", None), ("proposal", "recital", "2", None),
    ]
    assert units["proposal"][1][4:] == ("TITLE I — GENERAL PROVISIONS", None, "This lays down rules.")


def test_legacy(units):
    assert units["legacy"] == [
        ("legacy", "annex", "ANNEX — TERMS REFERRED TO", "ANNEX — TERMS REFERRED TO", None, None, "1. Terms excluding liability."),
        ("legacy", "annex", "II", "ANNEX II", None, None, "Rest."),
        ("legacy", "article", "1", "Objective", "CHAPTER I — RULES", None, "The purpose is to approximate."),
        ("legacy", "article", "2", "Definitions", "CHAPTER I — RULES", "SECTION 1 — Own", "(a) “organizer” means the person;"),
        ("legacy", "definition", None, "organizer", None, None, "the person"),
        ("legacy", "recital", "1", None, None, None, "Whereas travel matters;"),
        ("legacy", "recital", "5", None, None, None, "numbered reason"),
        ("legacy", "recital", "6", None, None, None, "Whereas the consumer should be protected;"),
    ]


HOSTILE = {
    "tags": "<a " * 330_000, "nested": "<div>x" * 100_000, "subdivisions": '<div class="eli-subdivision"><p class="oj-ti-art">Article 1</p>' * 10_000, "items": "<ul><li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000,
    "ends": "<div>" * 20_000 + "</table></li>" * 40_000, "classes": '<p class="x ' * 90_000, "fragments": "<TXT_TE>" * 120_000, "comments": "<!--" * 250_000, "quotes": '<a title="x>y ' * 70_000, "tables": "<table><tr><td>x" * 60_000, "spaces": "<p>" + " " * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_pages_are_walked_in_linear_time(name):
    start = time.process_time()
    for _ in markup.blocks_of(1, HOSTILE[name]):
        pass
    assert time.process_time() - start < 5


def test_hostile_pages_are_parsed(spark):
    pages = spark.createDataFrame(list(enumerate(HOSTILE.values())), "doc_id long, html string").repartition(4)
    start = time.time()
    assert html_laws.parsed(pages).where("kind = 'article'").count() == 10_000
    assert flat_laws.paragraphs(pages).count() >= 0 and proposals.paragraphs(pages).count() >= 0
    assert time.time() - start < 90
