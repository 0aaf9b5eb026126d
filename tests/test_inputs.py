"""Archives of laws, the index of a law and prompts."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lexspark.operators import grounded, prompts
from lexspark.sources import archives


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return bytearray(out.getvalue())


def test_archives(spark):
    declared = '<?xml version="1.0"?>\n<A/>'
    zips = {
        "order": packed({"a.fmx.xml": declared, "b.fmx.xml": "<B/>", "m.doc.fmx.xml": '<R FILE="b.fmx.xml"/><R FILE="m.doc.fmx.xml"/><R FILE="a.fmx.xml"/><R FILE="none.fmx.xml"/>'}),
        "silent": packed({"b.fmx.xml": "<B/>", "a.fmx.xml": declared, "m.doc.fmx.xml": "<DOC/>"}), "old": packed({"m.doc.xml": '<R FILE="z.xml"/><R FILE="y.xml"/>', "y.xml": "<Y/>", "z.xml": "<Z/>", "w.xml": "<W/>"}),
        "bare": packed({"a.fmx.xml": "<A/>"}), "empty": packed({}), "broken": packed({"a.fmx.xml": "<A/>" * 99, "m.doc.fmx.xml": ""})[:60], "none": bytearray(b""),
    }
    files = [(law, "x.zip", content) for law, content in zips.items()] + [("order", "1.xml", bytearray(b"<not/>")), ("several", "2.xml", bytearray(b"<B/>")), ("several", "1.xml", bytearray(declared.encode())), ("several", "1.xml.txt", bytearray(b"x")),
        ("one", "1.xml", bytearray(declared.encode())), ("nothing", "a.txt", bytearray(b"x")), (None, "1.xml", bytearray(b"x")), ("null", "1.xml", None)]
    table = spark.createDataFrame(files, "law string, name string, content binary").repartition(3)
    got = {r.law: (r.xml, r.error) for r in archives.laws(table).collect()}
    whole = lambda *parts: archives.HEAD + "\n".join(parts) + archives.TAIL
    assert {k: v[0] for k, v in got.items()} == {
        "order": whole("<B/>", "<A/>"), "silent": whole("<B/>", "<A/>"), "old": whole("<Z/>", "<Y/>"), "several": whole("<A/>", "<B/>"), "one": declared, "bare": None, "empty": None, "broken": None, "none": None,
    }
    assert {k for k, v in got.items() if v[1]} == {"bare", "empty", "broken", "none"}
    assert archives.laws(table.limit(0)).count() == 0


def test_skeleton(spark):
    rows = [(1, 1, "1", "Scope", "CHAPTER I", "General", None, None), (1, 2, "2", None, "CHAPTER II", None, "SECTION 1", "Rights"), (1, 3, "3", "", "CHAPTER II", None, "SECTION 1", "other"), (1, 4, "4", "Last", "CHAPTER I", "x", None, None), (2, 1, "1", None, None, None, None, None)]
    table = spark.createDataFrame(rows, "law long, ordinal long, number string, title string, chapter string, chapter_title string, section string, section_title string")
    got = {r.law: r.skeleton for r in prompts.skeletons(table, "2").collect()}
    assert got == {1: "CHAPTER I — General\n    Art. 1 — Scope\n    Art. 4 — Last\nCHAPTER II\nSECTION 1 — Rights\n    Art. 2   ← focus\n    Art. 3", 2: "    Art. 1"}


def test_summary_inputs(spark):
    articles = spark.createDataFrame([(1, 1, "1", "t", "<p>x</p>" + "y" * 1300), (1, 2, " ", "t", "no number"), (1, 3, "3", None, "<p></p>"), (1, 4, "4", None, "z&amp;")], "law long, ordinal long, number string, title string, text string")
    recitals = spark.createDataFrame([(1, k, str(k), f"r{k}") for k in range(1, 12)], "law long, ordinal long, number string, text string")
    mentions = spark.createDataFrame([(1, f"act {k:02}") for k in range(15) for _ in range(1 + k % 3)] + [(1, None)], "law long, label string")
    (row,) = prompts.summary_inputs(articles, recitals, mentions).collect()
    assert [(a.number, len(a.text)) for a in row.articles] == [("1", 1203), ("4", 2)] and [r.number for r in row.recitals] == [str(k) for k in range(1, 9)]
    assert [c.label for c in row.candidates] == [f"act {k:02}" for k in (2, 5, 8, 11, 14, 1, 4, 7, 10, 13, 0, 3)]


def test_prompt(spark):
    make = spark.createDataFrame
    chosen = make([(7, "6"), (8, "1")], "law long, number string")
    articles = make([(7, 2, "6", "Lawful", "Personal data."), (8, 1, "1", None, None)], "law long, ordinal long, number string, title string, text string")
    definitions = make([(7, 1, "personal data", None)], "law long, ordinal long, term string, definition string")
    links = make([(7, "6", 3, 1.0)], "law long, number string, recital long, score double")
    recitals = make([(7, 3, "Reason.")], "law long, recital long, text string")
    cases = make([(7, "6", "C1", "2020-01-01", None, "1", "a"), (7, "6", "C2", None, "Second", None, "")], "law long, number string, celex string, date string, name string, paragraph string, point string")
    found = prompts.bundle_prompts(grounded.bundles(chosen, articles, definitions, links, recitals, cases), F.lit("Why?"))
    got = {r.law: r.prompt for r in found.collect()}
    assert got[7].split("\n") == [
        "[LAW] 7", "[ARTICLES PROVIDED] 6", "", "[ARTICLE 6 — Lawful]", "Personal data.", "", "[DEFINITIONS USED IN THESE ARTICLES]", '"personal data": ', "", "[RELATED RECITALS]", "Recital 3: Reason.", "",
        "[CJEU CASE LAW (cases citing any of the provided articles)]", "C1 (2020-01-01)", "  Matching refs: Art. 6(1)(a)", "C2 — Second", "  Matching refs: Art. 6", "", "[QUESTION]", "Why?",
    ]
    assert "No CJEU judgments" in got[8] and got[8].endswith("[QUESTION]\nWhy?")
