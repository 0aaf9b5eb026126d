"""Answers held against laws and cases; bundles."""

from __future__ import annotations

import json

import pytest

from lexspark.operators import grounded

SUMMARY = {
    "purpose": {"text": "It protects personal data.", "citations": ["1", "999"]}, "scope": {"text": "It applies to processing.", "citations": ["1"]},
    "keyObligations": [{"text": "Data must be processed lawfully.", "citations": ["5"]}, {"text": "Invalid obligation is dropped.", "citations": ["999"]}], "structure": "General provisions, then principles.",
    "relatedInstruments": [{"label": "Directive 95/46/EC", "celex": "31995L0046", "relationship": "Predecessor."}, {"label": "Invented Act", "celex": "39999X0000", "relationship": "Rejected."}],
}


@pytest.fixture(scope="module")
def law(spark):
    articles = spark.createDataFrame([(1, "1"), (1, "5"), (1, "5"), (1, None), (2, "999")], "law long, number string")
    instruments = spark.createDataFrame([(1, 1, "Directive 95/46/EC", "31995L0046"), (1, 2, None, "x")], "law long, ordinal long, label string, celex string")
    return articles, instruments


def test_summary(spark, law):
    variants = {
        "whole": SUMMARY, "bare": SUMMARY | {"purpose": "bare <b>text</b>"}, "scope": SUMMARY | {"scope": {"text": "x", "citations": ["Art. 9"]}}, "prefix": SUMMARY | {"scope": {"text": "x", "citations": ["Art. 5", "article 5", None, 5]}},
        "types": SUMMARY | {"keyObligations": "none", "structure": ["x"]}, "many": SUMMARY | {"keyObligations": [{"text": f"o{k}", "citations": ["1"]} for k in range(12)]}, "structure": SUMMARY | {"structure": " "}, "long": SUMMARY | {"structure": "y" * 2000},
    }
    rows = [(name, json.dumps(x)) for name, x in variants.items()] + [("none", None), ("text", "no"), ("broken", '{"purpose": ')]
    answers = spark.createDataFrame(rows, "name string, answer string").selectExpr("1L as law", "answer")
    got = {r.answer: r for r in _with_answer(answers, law)}
    of = {name: got[x] for name, x in rows}
    whole = of["whole"]
    assert whole.error is None and whole.purpose.citations == ["1"] and [o.citations for o in whole.key_obligations] == [["5"]]
    assert [(x.label, x.celex, x.relationship) for x in whole.related_instruments] == [("Directive 95/46/EC", "31995L0046", "Predecessor.")]
    assert (of["bare"].purpose.text, of["bare"].purpose.citations) == ("bare text", []) and of["prefix"].scope.citations == ["5"]
    assert len(of["many"].key_obligations) == 8 and of["long"].structure == "y" * 1000 + "..."
    assert [of[n].error for n in ("scope", "types", "structure", "none", "text", "broken")] == ["no cited scope", "no cited key obligations", "no structure", "no JSON object", "no JSON object", "no JSON object"]
    assert of["scope"].purpose is None


def _with_answer(answers, law):
    """One law per answer, so that rows can be told apart."""
    numbered = answers.collect()
    spark = answers.sparkSession
    found = []
    table = spark.createDataFrame([(k, r.answer) for k, r in enumerate(numbered)], "law long, answer string")
    articles, instruments = (t.where("law = 1").drop("law").crossJoin(table.select("law")).select(*t.columns) for t in law)
    for r in grounded.grounded_summaries(table, articles, instruments).collect():
        row = r.asDict() | {"answer": numbered[r.law].answer}
        found.append(type("Row", (), row))
    return found


def test_laws_of_their_own(spark, law):
    """A law's articles don't ground another's answer; laws without articles ground nothing."""
    answers = spark.createDataFrame([(2, json.dumps(SUMMARY)), (3, json.dumps(SUMMARY)), (3, json.dumps(SUMMARY)), (None, "x")], "law long, answer string")
    rows = grounded.grounded_summaries(answers, *law).collect()
    assert len(rows) == 4 and sorted((r.law or 0, r.error) for r in rows) == [(0, "no JSON object"), (2, "no cited scope"), (3, "no cited scope"), (3, "no cited scope")]
    assert grounded.grounded_summaries(answers.limit(0), *law).count() == 0


DIGEST = {"summary": "The Court links Article 6 to a legal basis.", "noCaseLaw": False, "themes": [{"name": "Legal basis", "description": "It must rest on one.", "cites": [{"ecli": "ECLI:EU:C:2020:559", "declarationNumber": "1"}, {"ecli": "ECLI:EU:C:2099:999", "declarationNumber": "1"}]}]}


def test_digest(spark):
    cases = spark.createDataFrame([(1, "6", 1, "62018CJ0311", "ECLI:EU:C:2020:559", "C-311/18", "Schrems II", ["1"]), (1, "5", 1, "62020CJ0001", "ECLI:EU:C:2021:1", None, None, None)],
                                  "law long, article string, ordinal long, celex string, ecli string, case_number string, name string, declarations array<string>")
    ungrounded = DIGEST | {"themes": [DIGEST["themes"][0] | {"cites": DIGEST["themes"][0]["cites"][1:]}]}
    celex = DIGEST | {"themes": [DIGEST["themes"][0] | {"cites": [{"celex": "62018CJ0311", "paragraph": 7}, {"celex": "62018CJ0311"}, "x", None]}]}
    answers = [(1, "6", json.dumps(DIGEST)), (1, "5", json.dumps(DIGEST)), (1, "7", json.dumps(DIGEST)), (2, "6", json.dumps(DIGEST)), (1, "6", json.dumps(ungrounded)), (1, "6", json.dumps(celex)), (1, "6", json.dumps(DIGEST | {"noCaseLaw": True})), (1, "6", "none"), (1, "6", None)]
    rows = grounded.grounded_digests(spark.createDataFrame(answers, "law long, article string, answer string"), cases).collect()
    assert len(rows) == len(answers)
    grounded_rows = [r for r in rows if r.no_case_law is False]
    cites = {tuple(c) for r in grounded_rows for t in r.themes for c in t.cites}
    assert cites == {("ECLI:EU:C:2020:559", "62018CJ0311", "C-311/18", "Schrems II", d) for d in ("1", None)} and [len(t.cites) for r in grounded_rows for t in r.themes] == [1, 1]
    assert sorted(str(r.no_case_law) for r in rows) == ["False"] * 2 + ["None"] * 2 + ["True"] * 5
    assert all(r.themes == [] and r.summary == "" for r in rows if r.no_case_law is not False)


def test_bundle(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    chosen = make([(1, "6"), (1, "5"), (1, "6"), (2, "9"), (1, None)], "law long, number string")
    articles = make([(1, 2, "6", "Lawful", "Processing of Personal Data"), (1, 1, "5", None, "Principles"), (1, 3, "7", "x", "consent"), (2, 1, "1", "x", "y")], "law long, ordinal long, number string, title string, text string")
    definitions = make([(1, 1, "personal data", "any information"), (1, 2, "consent", "not used"), (1, 3, "", "empty"), (1, 4, None, "null")], "law long, ordinal long, term string, definition string")
    links = make([(1, "6", k, float(k)) for k in range(1, 9)] + [(1, "5", 2, 9.0), (1, "7", 1, 99.0)], "law long, number string, recital long, score double")
    recitals = make([(1, k, f"r{k}") for k in range(1, 8)], "law long, recital long, text string")
    cases = make([(1, "6", "C1", "2020-01-01", "a", "1", None), (1, "5", "C1", "2020-01-01", "a", None, None), (1, "6", "C2", None, "b", "2", "a"), (1, "6", "C3", "2021-01-01", "c", None, None), (1, "7", "C4", "2022-01-01", "d", None, None)],
                 "law long, number string, celex string, date string, name string, paragraph string, point string")
    (row,) = grounded.bundles(chosen, articles, definitions, links, recitals, cases).collect()
    assert [a.number for a in row.articles] == ["5", "6"] and [d.term for d in row.definitions] == ["personal data"]
    assert [(r.recital, r.text) for r in row.recitals] == [(2, "r2"), (8, None), (7, "r7"), (6, "r6"), (5, "r5"), (4, "r4"), (3, "r3")]
    assert [(c.celex, [tuple(r) for r in c.refs]) for c in row.cases] == [("C3", [("6", None, None)]), ("C1", [("5", None, None), ("6", "1", None)]), ("C2", [("6", "2", "a")])]
