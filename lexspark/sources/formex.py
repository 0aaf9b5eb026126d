"""Formex acts as typed rows.

Spark's XML reader loses the order of mixed content, so each document's tree is walked in Python, one row at a time inside
Arrow batches; what comes out are plain rows for joins and windows. A document that isn't well-formed gives one row with ``error``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import languages

SCHEMA = "doc_id long, kind string, ordinal long, number string, title string, text string, chapter string, section string, error string"
_ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in SCHEMA.split(", "))])
#: Bytes of documents read, and characters of rows written, at a time: what a worker holds doesn't grow with the table.
PIECE = 1_000_000
_QUOTES = {"QUOT.START": "‘", "QUOT.END": "’"}


def plain_text(node: ET.Element | None) -> str:
    """Text of a subtree in document order, white space collapsed."""
    if node is None:
        return ""

    found: list[str] = []
    todo: list[ET.Element | str] = [node]
    while todo:  # a stack, as documents may be nested deeply
        e = todo.pop()
        if isinstance(e, str):
            found.append(e)
            continue
        found += (_QUOTES.get(e.tag, ""), e.text or "")
        todo += [x for child in reversed(e) for x in (child.tail or "", child)]
    return re.sub(r"[ \t\r\n]+", " ", "".join(found)).strip(" ")


@functools.cache
def forms(lang: str) -> dict[str, re.Pattern]:
    """A language's patterns for articles, annexes, titles of definitions, and definitions."""
    own = languages.patterns(lang)
    return {k: re.compile(own[k], re.I) for k in ("article", "definition", "means", "fallback")} | {"annex": re.compile(rf"^(?:{languages.WORDS[lang][3]})\s*([IVXLC]+|\d+)?", re.I)}


def language(root: ET.Element, lang: str | None) -> str:
    """The language that the document names, else the one given, else English."""
    named = root.find(".//BIB.INSTANCE/LG.DOC")
    return languages.known(plain_text(named) if named is not None else lang)


def defined(text: str, lang: str) -> tuple[str, str] | None:
    """Term and definition of an item: by the language's verb, else, where the term comes first, by what marks the term."""
    own = forms(lang)
    m = own["means"].search(text) or (None if lang in languages.VERB_FIRST else own["fallback"].search(text))
    if m is None:
        return None
    term, definition = m[1].strip(), re.sub("[;.]$", "", text[m.end() :].strip())
    return (term, definition) if term and definition else None


def display_title(parts: list[str], lang: str) -> str:
    """The title of an act from the paragraphs of its heading: the first phrase in parentheses of 5 to 80 characters that isn't
    the note on the EEA, and what stands before the institution or the date, each word capitalised."""
    institution, date, note = languages.TITLES[lang]
    phrases = (m[1] for p in parts if (m := re.search(r"\(([^)]{5,80})\)", p)))
    short = next((x for x in phrases if not re.search(note, x, re.I)), "")
    whole = " ".join(parts)
    main = re.split(institution, whole, maxsplit=1, flags=re.I)[0].strip()
    if main == whole:
        main = re.split(date, whole, maxsplit=1, flags=re.I)[0].strip()
    main = re.sub(r"(?:^|\s)\S", lambda m: m[0].upper(), main.lower())
    main = re.sub(r"\b(?:Eu|Ec|Eec|Euratom)\b", lambda m: m[0].upper(), main, flags=re.I)
    return f"{short} — {main}" if short and main and short not in main else short or main


def shredded(doc_id: int, xml: str, lang: str | None = None) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        yield doc_id, "error", 0, None, None, None, None, None, str(e)
        return
    lang = language(root, lang)
    own = forms(lang)
    heading = next((h for e in (root, *root.iter("ACT")) if (h := e.find("TITLE/TI")) is not None), None)
    paragraphs = [] if heading is None else [t for p in heading.iter("P") if (t := plain_text(p))]
    if paragraphs:
        yield doc_id, "title", 1, None, display_title(paragraphs, lang), " ".join(paragraphs), None, None, None
    recitals = []
    for k, consid in enumerate(root.iter("CONSID"), 1):
        number = plain_text(consid.find(".//NO.P")).strip("()") or str(k)
        body = consid.find(".//TXT")
        leading = re.match(r"\s*(\d+)", number)
        recitals.append((int(leading[1]) if leading else 0, k, number, plain_text(consid if body is None else body)))
    for k, (_, _, number, text) in enumerate(sorted(recitals), 1):  # in the order of their numbers
        yield doc_id, "recital", k, number, None, text, None, None, None
    articles = 0
    has_defined = False
    # (node, chapter, section, depth), in document order
    todo = [(t, None, None, 0) for t in reversed(list(root.iter("ENACTING.TERMS")))]
    while todo:
        node, chapter, section, depth = todo.pop()
        if node.tag == "ARTICLE":
            articles += 1
            heading, title = plain_text(node.find("TI.ART")), plain_text(node.find("STI.ART"))
            found = own["article"].search(heading)
            number = found[1] if found else node.get("IDENTIFIER", "").lstrip("0") or str(articles)
            body = [plain_text(c) for c in node if c.tag not in ("TI.ART", "STI.ART")]
            yield doc_id, "article", articles, number, title or None, " ".join(filter(None, body)), chapter, section, None
            if not has_defined and own["definition"].search(title):
                has_defined = True
                items = (defined(plain_text(x), lang) for x in node.iter("TXT"))
                for k, (term, meaning) in enumerate(filter(None, items), 1):
                    yield doc_id, "definition", k, number, term, meaning, chapter, section, None
            continue
        if node.tag == "DIVISION":
            name = " — ".join(filter(None, (plain_text(node.find("TITLE/TI")), plain_text(node.find("TITLE/STI"))))) or None
            chapter, section = (name, None) if depth == 0 else (chapter, name)
            depth += 1
        todo += [(c, chapter, section, depth) for c in reversed(list(node)) if c.tag != "TITLE"]
    for k, annex in enumerate(root.iter("ANNEX"), 1):
        title = plain_text(annex.find("TITLE"))
        found = own["annex"].search(title)
        yield doc_id, "annex", k, found[1] if found and found[1] else str(k), title or None, " ".join(filter(None, (plain_text(c) for c in annex if c.tag != "TITLE"))), None, None, None


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches in which ``column`` holds about ``most_bytes``."""
    for b in batches:
        step = max(1, most_bytes * b.num_rows // max(1, b.column(column).nbytes))
        yield from (b.slice(at, step) for at in range(0, b.num_rows, step))


def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of batches of doc_id, xml and lang, about ``PIECE`` at a time."""
    for b in slices(batches, PIECE, "xml"):
        rows: list[tuple] = []
        size = 0
        for i, x, code in zip(b.column("doc_id"), b.column("xml"), b.column("lang")):
            if not x.is_valid:
                continue
            for r in shredded(i.as_py(), x.as_py(), code.as_py()):
                rows.append(r)
                size += 200 + len(r[5] or "")
                if size > PIECE:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def parsed(acts: DataFrame) -> DataFrame:
    """Titles, recitals, articles, definitions and annexes of ``acts`` (doc_id, xml, and lang where a document doesn't name its
    language); null documents give no rows."""
    lang = F.col("lang") if "lang" in acts.columns else F.lit(None)
    return acts.select("doc_id", "xml", lang.cast("string").alias("lang")).mapInArrow(shred, SCHEMA)
