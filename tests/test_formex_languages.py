"""Formex acts in several languages: titles, numbers, definitions, annexes."""

from __future__ import annotations

import pytest

from lexspark.functions import languages
from lexspark.sources import formex


def act(lang, heading, definitions, label, items, annex=""):
    named = f"<BIB.INSTANCE><LG.DOC>{lang}</LG.DOC></BIB.INSTANCE>" if lang else ""
    rows = "".join(f"<ITEM><NP><TXT>{x}</TXT></NP></ITEM>" for x in items)
    paragraphs = "".join(f"<P>{x}</P>" for x in heading)
    consid = "".join(f"<CONSID><NP><NO.P>({n})</NO.P><TXT>reason {n}</TXT></NP></CONSID>" for n in (2, 10, 1))
    return f"""<ACT>{named}<TITLE><TI>{paragraphs}</TI></TITLE><PREAMBLE><GR.CONSID>{consid}</GR.CONSID></PREAMBLE><ENACTING.TERMS><ARTICLE IDENTIFIER="004"><TI.ART>{label}</TI.ART><STI.ART>{definitions}</STI.ART>{rows}</ARTICLE>
<ARTICLE IDENTIFIER="007"><TI.ART>?</TI.ART></ARTICLE><ARTICLE><TI.ART>?</TI.ART></ARTICLE></ENACTING.TERMS>{f'<ANNEX><TITLE>{annex}</TITLE></ANNEX>' if annex else ''}</ACT>"""


Q = "<QUOT.START/>{}<QUOT.END/>"
CASES = {
    "EN": (["REGULATION (EU) 2016/679 OF THE EUROPEAN PARLIAMENT AND OF THE COUNCIL", "of 27 April 2016 (General Data Protection Regulation)", "(Text with EEA relevance)"], "Definitions", "Article 4a", [Q.format("user") + " means a person;", "intro"],
           ("General Data Protection Regulation — Regulation (EU) 2016/679", "4a", [("user", "a person")])),
    "DE": (["VERORDNUNG (EU) 2016/679 DES EUROPÄISCHEN PARLAMENTS", "vom 27. April 2016 (Datenschutz-Grundverordnung)"], "Begriffsbestimmungen", "Artikel 4", [Q.format("Nutzer") + " eine Person;", Q.format("Daten") + " bezeichnet alle Angaben"],
           ("Datenschutz-Grundverordnung — Verordnung (EU) 2016/679", "4", [("Nutzer", "eine Person"), ("Daten", "alle Angaben")])),
    "FR": (["RÈGLEMENT du 3 mai"], "Définitions", "Article 4", ["on entend par " + Q.format("usager") + " une personne", Q.format("x") + ": rien"], ("Règlement", "4", [("usager", "une personne")])),
    "HU": (["2016. évi rendelet"], "Fogalommeghatározások", "4. cikk", [Q.format("adat") + ": minden"], ("2016.", "4", [("adat", "minden")])),
    "LT": (["REGLAMENTAS"], "Apibrėžimai", "Straipsnis 4", ["vartotojas – asmuo"], ("Reglamentas", "4", [("vartotojas", "asmuo")])),
    "SV": (["FÖRORDNING"], "Definitioner", "Artikel 4", ["användare: en person"], ("Förordning", "4", [("användare", "en person")])),
    "BG": (["РЕГЛАМЕНТ от 1999"], "Определения", "Член 4", [Q.format("данни") + " означава всичко"], ("Регламент", "4", [("данни", "всичко")])),
}


@pytest.fixture(scope="module")
def rows(spark):
    acts = [(k, act(lang, *CASES[lang][:4], annex="ALLEGATO" if lang == "IT" else ""), None) for k, lang in enumerate(CASES)]
    acts += [(100, act("", *CASES["DE"][:4], annex="ANHANG IV Formulare"), "de"), (101, act("", *CASES["EN"][:4]), "xx"), (102, None, "EN"), (103, "<ACT><broken", None), (104, "<ACT/>", None)]
    return formex.parsed(spark.createDataFrame(acts, "doc_id long, xml string, lang string")).collect()


@pytest.mark.parametrize("k, lang", list(enumerate(CASES)))
def test_language(rows, k, lang):
    title, number, defined = CASES[lang][4]
    own = sorted((r for r in rows if r.doc_id == k), key=lambda r: (r.kind, r.ordinal))
    assert [r.title for r in own if r.kind == "title"] == [title]
    assert [r.number for r in own if r.kind == "article"] == [number, "7", "3"]
    assert [(r.title, r.text) for r in own if r.kind == "definition"] == defined
    assert [r.number for r in own if r.kind == "recital"] == ["1", "2", "10"]


def test_language_from_the_column(rows):
    assert [r.number for r in rows if r.doc_id == 100 and r.kind == "annex"] == ["IV"]
    assert [r.title for r in rows if r.doc_id == 100 and r.kind == "definition"] == ["Nutzer", "Daten"]
    assert [r.title for r in rows if r.doc_id == 101 and r.kind == "definition"] == ["user"]
    assert [r.kind for r in rows if r.doc_id in (102, 103, 104)] == ["error"]


def test_tables_are_whole():
    assert set(languages.WORDS) == set(languages.TITLES) and len(languages.WORDS) == 24
    for lang in languages.WORDS:
        formex.forms(lang)


def test_rows_leave_a_worker_in_small_batches():
    import pyarrow as pa

    from lexspark.sources import formex

    xml = "<ACT><ENACTING.TERMS>" + "".join(f"<ARTICLE><TI.ART>Article {k}</TI.ART><PARAG>{'word ' * 100}</PARAG></ARTICLE>" for k in range(20)) + "</ENACTING.TERMS></ACT>"
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "xml": [xml if k % 5 else None for k in range(500)], "lang": pa.nulls(500, pa.string())})
    found = list(formex.shred(iter([whole])))
    assert sum(b.num_rows for b in found) == 400 * 20 and max(b.nbytes for b in found) < 2 * formex.PIECE
    assert [i for b in found for i in b.column("doc_id").to_pylist()] == [k for k in range(500) if k % 5 for _ in range(20)]
