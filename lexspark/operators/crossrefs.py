"""Cross-references in a law's text: to its own articles and recitals and to other acts, in 24 languages, and links to them.

Spark's patterns give no places of their matches, so spans are found in Python inside Arrow batches; everything after that is
rows. An article named right before an act, with the language's connecting word between, belongs to that act: the two become
one reference, each taken once. Of spans that overlap the leftmost is kept, of those the longest.

A range of articles up to 51 wide is all of them, of a wider one only its first is known to be meant ("and" between two
numbers is a range too, but in a list with commas it isn't); of recitals likewise up to 1,000.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import languages, refs

# The words for the three kinds of acts in the journal's languages, as they stand before a number.
ACTS = {
    "regulation": "Regulation Verordnung Règlement Reglamento Regolamento Regulamento Verordening Förordning Forordning Asetus Nařízení Nariadenie Rendelet Regulamentul Naredba Uredba Regula Regulācija Reglamentas Κανονισμός Regolament Регламент Rialachán",
    "directive": "Directive Richtlinie Directiva Direttiva Diretiva Richtlijn Direktiv Direktiivi Směrnice Smernica Irányelv Direktiva Direktīva Direktyva Οδηγία Директива Treoir",
    "decision": "Decision Beschluss Décision Decisión Decisione Decisão Besluit Beslut Päätös Rozhodnutí Rozhodnutie Határozat Decizia Odluka Lēmums Sprendimas Απόφαση Deċiżjoni Решение Cinneadh",
}
KIND = {word.lower(): kind for kind, words in ACTS.items() for word in words.split()}
WIDEST, WIDEST_RECITALS = 50, 1_000
_ACT = re.compile(rf"(?<![^\W\d_])({'|'.join(sorted(KIND, key=lambda w: (-len(w), w)))})\s+(?:\([A-Z]+\)\s+)?(?:No\.?\s+)?(\d{{2,4}}/\d+(?:/[A-Z]+)?)", re.I)
_TARGET = re.compile(r"(\d{2,4})/(\d+)(?:/([A-Z]+))?", re.I)
_PARAGRAPH, _POINT = re.compile(r"\((\d+)\)"), re.compile(r"\(([a-z])\)", re.I)
_TAG = re.compile(r"(<[^>]+>)")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    target: str
    paragraph: str | None = None
    point: str | None = None
    article: str | None = None
    act_type: str | None = None
    year: str | None = None
    number: str | None = None
    suffix: str | None = None


FIELDS = ["kind", "target", "paragraph", "point", "article", "act_type", "year", "number", "suffix"]
REFERENCE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), *(T.StructField(n, T.StringType()) for n in (*FIELDS, "raw"))]))


class Patterns(NamedTuple):
    mention: re.Pattern  # an article or several, 1: the first number, 2: more of a list, 3: the end of a range
    single: re.Pattern  # one article, 1: its number
    recital: re.Pattern
    connector: re.Pattern


@functools.cache
def patterns(lang: str) -> Patterns:
    word, recital = languages.WORDS[lang][0], languages.WORDS[lang][5]
    begin, parts = r"(?<![^\W\d_])", r"(?:\(\d+\))?(?:\([a-z]\))?"
    if lang == "HU":
        mention = single = rf"({languages.NUMBER}){word}{parts}()()"
    else:
        single = rf"{begin}(?:{word})s?\s+(\d+[a-z]?\b){parts}"
        mention = rf"{single}(?:((?:\s*,\s*\d+[a-z]?\b(?!\())+(?:\s*,?\s+and\s+\d+[a-z]?\b)?)|\s+(?:to|and)\s+(\d+[a-z]?\b))?"
    of = rf"(?:{recital})\s+\(?(\d+)\)?(?:\s+(?:to|and)\s+\(?(\d+)\)?)?"
    return Patterns(re.compile(mention, re.I), re.compile(single, re.I), re.compile(of), re.compile(rf"\s+{languages.CONNECTORS.get(lang, 'of')}\s+", re.I))


def group(m: re.Match, k: int) -> str | None:
    return m[k] or None if k <= (m.re.groups or 0) else None


def of_range(first: str, last: str, widest: int) -> list[str] | None:
    """All numbers of a range, None if it runs backwards or is too wide."""
    a, b = (int(re.match(r"\d+", x)[0]) for x in (first, last))
    return [str(n) for n in range(a, b + 1)] if a <= b <= a + widest else None


def articles(text: str, lang: str) -> Iterator[Span]:
    for m in patterns(lang).mention.finditer(text):
        many = [m[1], *re.findall(r"\d+[a-zA-Z]?", m[2])] if group(m, 2) else None
        if group(m, 3):
            many = of_range(m[1], m[3], WIDEST) or [m[1]]
        if many:
            yield from (Span(m.start(), m.end(), "article", n) for n in many)
        else:
            yield one_article(m)


def one_article(m: re.Match) -> Span:
    paragraph, point = _PARAGRAPH.search(m[0]), _POINT.search(m[0])
    return Span(m.start(), m.end(), "article", m[1], paragraph and paragraph[1], point and point[1])


def recitals(text: str, lang: str) -> Iterator[Span]:
    for m in patterns(lang).recital.finditer(text):
        many = of_range(m[1], m[2], WIDEST_RECITALS) if m[2] else None
        yield from (Span(m.start(), m.end(), "recital", n) for n in many or [m[1]])


def acts(text: str) -> Iterator[Span]:
    """A part of four digits is the year (the first before the second), else a first part of two digits is one."""
    for m in _ACT.finditer(text):
        first, second, suffix = _TARGET.fullmatch(m[2]).groups()
        year, number = (first, second) if len(first) == 4 else (second, first) if len(second) == 4 else (None, None)
        if year is None and len(first) == 2:
            year, number = str(int(first) + (1900 if int(first) >= 50 else 2000)), second
        yield Span(m.start(), m.end(), "external", m[2], act_type=KIND[m[1].lower()], year=year, number=number, suffix=suffix)


def merged(text: str, own: list[Span], others: list[Span], lang: str) -> list[Span]:
    """Articles, acts, and articles of acts: each act is taken by the first article that stands right before it."""
    free = {a.start: a for a in others}
    left, joined = [], []
    for ref in own:
        gap = patterns(lang).connector.match(text, ref.end)
        act = free.pop(gap.end(), None) if gap else None
        if act is None:
            left.append(ref)
        else:
            joined.append(act._replace(start=ref.start, article=ref.target, paragraph=ref.paragraph, point=ref.point))
    return left + sorted(free.values()) + joined


def found(text: str, lang: str) -> list[Span]:
    """A text's references, each (kind, target, paragraph, point) once: articles, recitals, other acts, articles of acts."""
    both = merged(text, list(articles(text, lang)), list(acts(text)), lang)
    ordered = [s for s in both if s.kind == "article"] + list(recitals(text, lang)) + [s for s in both if s.kind == "external"]
    once: dict[tuple, Span] = {}
    for s in ordered:
        once.setdefault((s.kind, s.target, s.paragraph, s.point), s)
    return list(once.values())


def leftmost_longest(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
    return kept


def plain(text: str) -> str:
    return text.replace("&", "&amp;").replace(" ", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def link(s: Span, label: str, lang: str) -> str:
    if s.kind == "article":
        named = {"class": "cross-ref", "data-ref-article": s.target, "href": f"#article-{s.target}", "title": f"Go to Article {s.target}"}
    else:
        search = f"{refs.SITE}/search.html?scope=EURLEX&text={quote_plus(label)}&lang={lang.lower()}&type=quick"
        named = {"class": "external-ref", "href": search, "target": "_blank", "rel": "noopener noreferrer", "title": f"Open {s.target} on EUR-Lex", "data-ref-raw": label}
        named |= {f"data-ref-{k.replace('_', '-')}": getattr(s, k) for k in ("article", "paragraph", "point", "act_type", "year", "number", "suffix")}
    return f"<a {' '.join(f'{k}=\"{html.escape(v)}\"' for k, v in named.items() if v)}>{plain(label)}</a>"


def with_links(page: str, lang: str) -> str:
    """HTML with links around references in its text, but not in text within links, defined terms or marked references."""
    parts, open_tags, closed_off = _TAG.split(page), [], 0
    for k, part in enumerate(parts):
        if k % 2:
            name = _NAME.match(part)
            if name is None or name[2].lower() in _VOID or part.endswith("/>"):
                continue
            tag = name[2].lower()
            if not name[1]:
                bars = tag == "a" or bool(re.search(r"\bclass\s*=\s*[\"'][^\"']*(?<![\w-])(?:defined-term|oj-ref)(?![\w-])", part))
                open_tags.append((tag, bars))
                closed_off += bars
            elif any(tag == t for t, _ in open_tags[-50:]):  # end tags without a start are passed over
                while True:
                    t, bars = open_tags.pop()
                    closed_off -= bars
                    if t == tag:
                        break
            continue
        if not part.strip() or closed_off:
            continue
        text = html.unescape(part)
        spans = merged(text, [one_article(m) for m in patterns(lang).single.finditer(text)], list(acts(text)), lang)
        out, at = [], 0
        for s in leftmost_longest(spans):
            out += (plain(text[at : s.start]), link(s, text[s.start : s.end], lang))
            at = s.end
        if out:
            parts[k] = "".join(out) + plain(text[at:])
    return "".join(parts)


@F.pandas_udf(REFERENCE)
def references(text: pd.Series, lang: pd.Series) -> pd.Series:
    """References of a text in a language (two letters; English where it isn't known); null for null."""

    def rows(t: str | None, code: str | None) -> list[dict] | None:
        if t is None:
            return None
        return [s._asdict() | {"raw": t[s.start : s.end]} for s in found(t, languages.known(code))]

    return pd.Series([rows(t, x) for t, x in zip(text, lang)], dtype=object)


@F.pandas_udf(T.StringType())
def linked(page: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([p if not p else with_links(p, languages.known(x)) for p, x in zip(page, lang)], dtype=object)


def extracted(units: DataFrame, key: list[str], text: str = "text", lang: Column | str = "lang") -> DataFrame:
    """One row per reference of ``units``: its key, ordinal from 1, place (start, end) and parts."""
    found_in = units.select(*key, F.posexplode(references(text, lang)).alias("i", "r"))
    return found_in.select(*key, (F.col("i") + 1).cast("long").alias("ordinal"), "r.*")


def longest_spans(spans: DataFrame, key: str, start: str = "start", end: str = "end", tie: str = "ordinal") -> DataFrame:
    """Of each text's spans the leftmost, then the longest, then the first by ``tie``, and so on behind its end.

    Which span comes next depends on the one before, so a text's spans are folded in order; only the last end is carried,
    however many spans there are. Rows without a start or end are left out.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, cursor = object(), None
        for rows in batches:
            keep = []
            for k, s, e in zip(rows[key], rows[start], rows[end]):
                if k != text:
                    text, cursor = k, None
                keep.append(cursor is None or s >= cursor)
                cursor = e if keep[-1] else cursor
            yield rows[keep]

    known = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(key).isNotNull())
    return known.repartition(key).sortWithinPartitions(key, start, F.desc(end), tie).mapInPandas(fold, known.schema)
