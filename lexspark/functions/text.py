"""Text functions as Column builders."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English stopwords that tokenisation drops (basic words, legal structure, procedure, filler, transitions).
STOPWORDS_EN = """
a an the and or but if then else when at by for with about against between into through during before after above below
to from up down in out on off over under again further once here there where why how all any both each few more most
other some such no nor not only own same so than too very can will just should now also therefore upon within without
union member states commission article paragraph eu european regulation regulations directive directives decision decisions
law act provisions measures shall may whereas pursuant accordance hereof thereof
apply applicable applied applies provide provided provides providing ensure ensures ensuring establish establishing regard regarding
refer referred include including included follow following follows make made take taken taking set given lay laying
relevant appropriate necessary competent concerned particular respect account case cases order view way ways manner
point points subject meaning need needs effect effects however furthermore especially certain inter alia
""".split()  # fmt: skip
# Words that don't count in acronyms.
ACRONYM_STOPWORDS = "of the and for on with to in by as a an text eea relevance union european council parliament".split()
# Words that carry little in a query.
LOW_SIGNAL_TERMS = "act eu of the and on for".split()


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Lower case, decomposed (NFKD), without combining marks U+0300..U+036F; Spark has no decomposition of its own."""
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f")
    return text.map(lambda x: x if x is None else x.lower() if x.isascii() else bare(x.lower()))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(without_marks(text), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.replace(normalized(text), F.lit(" "), F.lit(""))


def tokens(text: Column, stopwords: list[str] = STOPWORDS_EN) -> Column:
    """Lower-case tokens of three characters or more without stopwords; letters beyond U+024F are dropped. One pattern finds them in
    one pass, which takes a seventh of the time of replacing what isn't a token and splitting at white space."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\wÀ-ɏ]{3,}"), F.lit(0)), lambda t: ~t.isin(stopwords))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def summarized(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.trim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escaped(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def acronym(text: Column) -> Column:
    """Initials of the words that count (those with a digit whole), if they are 2 to 8 characters."""
    words = F.filter(F.split(normalized(text), " "), lambda w: (w != "") & ~w.isin(ACRONYM_STOPWORDS))
    short = F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), w).otherwise(F.substring(w, 1, 1))), "")
    return F.when(F.length(short).between(2, 8), short)


def acronym_variants(text: Column) -> Column:
    """The acronym of a title, and that of its first phrase in parentheses."""
    phrase = F.regexp_extract(text, r"\(([^)]+)\)", 1)
    return F.array_distinct(F.array_compact(F.array(acronym(text), acronym(phrase))))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def unpadded(digits: Column) -> Column:
    return digits.try_cast("int").cast("string")


# Characters that a registry's titles have for named references.
NAMED_CHARACTERS = {"nbsp": " ", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "ndash": "-", "mdash": "-", "hellip": "..."}
# Titles that say nothing about an act.
PLACEHOLDER_TITLES = ["Official Journal of the European Union", "CORRELATION TABLE"]
# Abbreviations that stay in capitals in a title.
CAPITALS = ["Eec", "Euratom", "Eu", "Ec", "Ue", "We"]


def collapsed(text: Column) -> Column:
    """White space, no-break spaces too, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def without_tags_or_references(html: Column) -> Column:
    """Tags go, the five common references become characters."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for written, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def replaced(text: Column, pattern: str, groups: int, by: Callable[..., Column]) -> Column:
    """``text`` with every match replaced by ``by`` of the match and of its groups."""

    def changed(t: Column) -> Column:
        found = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(groups + 1)))
        signs = F.transform(found, lambda m: by(*(m[f"g{k}"] for k in range(groups + 1))))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), signs, lambda around, sign: F.concat(around, F.coalesce(sign, F.lit("")))), "")

    return bound(text, changed)


def referenced(whole: Column, digits: Column, base: int) -> Column:
    """The character that a reference names; half a surrogate pair is U+FFFD, and a number beyond Unicode stays as written."""
    bare = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(bare) <= 7, F.conv(F.concat(F.lit("0"), bare), base, 10).cast("long"))
    return bound(number, lambda code: F.when(code.between(0xD800, 0xDFFF), "�").when(code <= 0x10FFFF, character(code)).otherwise(whole))


def paired(whole: Column, high: Column, low: Column, base: int) -> Column:
    """The character of two references that are the halves of a surrogate pair; other references stay as written."""
    first, second = (F.conv(x, base, 10).cast("long") for x in (high, low))
    return F.when(first.between(0xD800, 0xDBFF) & second.between(0xDC00, 0xDFFF), character(0x10000 + (first - 0xD800) * 1024 + second - 0xDC00)).otherwise(whole)


def decoded(text: Column) -> Column:
    """Character references: numbers first, then names, the ampersand last. Each step's text is worked out once."""
    return bound(text, lambda t: F.when(t.contains("&"), without_references(t)).otherwise(t))


def without_references(text: Column) -> Column:
    for mark, digits, half, base in (("x", "[0-9a-fA-F]+", "0*+d[89a-f][0-9a-f]{2}", 16), ("", "[0-9]+", "0*+5[5-7][0-9]{3}", 10)):
        text = replaced(text, f"(?i)&#{mark}({half});&#{mark}({half});", 2, lambda w, a, b: paired(w, a, b, base))  # noqa: B023
        text = replaced(text, f"(?i)&#{mark}({digits});", 1, lambda w, d: referenced(w, d, base))  # noqa: B023
    for name, plain in NAMED_CHARACTERS.items():
        text = F.regexp_replace(text, f"(?i)&{name};", plain)
    for written, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def registry_title(title: Column) -> Column:
    """A title, null if it is blank or a placeholder."""
    return bound(F.trim(title), lambda t: F.when((t != "") & ~t.isin(PLACEHOLDER_TITLES), t))


def recital_title(title: Column, most: int = 90) -> Column:
    """A generated title without quotes and closing punctuation, cut to ``most`` characters."""
    quotes = "\"'“”‘’"
    t = F.regexp_replace(title, f"^[{quotes}]+|[{quotes}]+$", "")
    return F.trim(F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"[.;:,\s]+$", ""), r"\s+", " ")), 1, most))


def stem_pattern(term: Column) -> Column:
    """A pattern that finds inflected forms: of each word all but its last three characters, three at least."""
    stems = F.transform(F.split(term, r"\s+"), lambda w: F.concat(F.regexp_replace(F.substring(w, F.lit(1), F.greatest(F.lit(3), F.length(w) - 3)), r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\S*")))
    return F.array_join(stems, r"\s+")


def display_title(text: Column) -> Column:
    """What stands before ``of``, each word capitalised, abbreviations in capitals."""
    out = F.initcap(F.lower(collapsed(F.get(F.split(text, r"(?i)\s+of\s+"), F.lit(0)))))
    for word in CAPITALS:
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", word.upper())
    return out


def short_title(title: Column) -> Column:
    """The first phrase in parentheses of 5 to 120 characters that isn't the note on the EEA; '' if there is none."""
    phrases = F.transform(F.regexp_extract_all(collapsed(title), F.lit(r"\(([^)]{5,120})\)"), F.lit(1)), lambda p: F.trim(p))
    return F.coalesce(F.get(F.filter(phrases, lambda p: (p != "") & ~p.rlike("(?i)text with eea relevance")), F.lit(0)), F.lit(""))


def without_reference(title: Column, reference: Column) -> Column:
    """A title without the reference that it begins with, unless nothing else is left."""
    raw = collapsed(title)
    rest = F.when(F.lower(raw).startswith(F.concat(F.lower(reference), F.lit(" "))), F.trim(F.substring(raw, F.length(reference) + 1, F.length(raw))))
    return F.coalesce(F.nullif(rest, F.lit("")), raw)


def bold_name(html: Column) -> Column:
    """A name in bold type: without tags, references and closing commas."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for written, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.trim(F.regexp_replace(out, "[,;]+$", ""))


def annex_title(title: Column, annex: Column) -> Column:
    """What follows the first dash of an annex's title; '' if the title is no more than the annex's name."""
    t, name = F.trim(title), F.lower(F.trim(annex))
    parts = F.filter(F.transform(F.split(t, "—"), lambda x: F.trim(x)), lambda x: x != "")
    bare = (name != "") & ((F.lower(t) == name) | F.lower(t).endswith(F.concat(F.lit(" "), name)))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " — ")).when(bare, "").otherwise(F.coalesce(t, F.lit("")))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in double or else in single quotes; null without one."""

    def value(t: Column) -> Column:
        double = F.when(t.rlike(rf'(?i)\b{name}="'), F.regexp_extract(t, rf'(?i)\b{name}="([^"]*)"', 1))
        return F.coalesce(double, first_match(t, rf"(?i)\b{name}='([^']*)'"))

    return bound(tag, value)


# Grammar of headings.
ARTICLE_HEADING, ANNEX_HEADING = r"(?i)^Article\s+\d+[A-Za-z]*$", r"(?i)^ANNEX(?:\s+[IVXLCDM0-9A-Za-z]+)?$"
DIVISION_MARK = r"(?i)^(TITLE|CHAPTER|SECTION)\s+([IVXLCDM0-9A-Z]+)(?:\s+(.*))?$"


def likely_article_title(line: Column) -> Column:
    """A line under a heading that is its title: short, no heading itself, not numbered, no sentence."""
    numbered = line.rlike(r"^\d+\.") | line.rlike(r"(?i)^\([a-z0-9ivxlcdm]+\)")
    return (line != "") & ~line.rlike(ARTICLE_HEADING) & ~line.rlike(ANNEX_HEADING) & ~numbered & (F.length(line) <= 180) & ~line.rlike("[.;!?]$")


def likely_division_title(line: Column, clean: bool = False) -> Column:
    """A line in capitals that is no heading itself; the white space of a ``clean`` one is collapsed already."""
    t = line if clean else collapsed(line)
    return (F.length(t) <= 220) & t.rlike("[A-Za-z]") & (t == F.upper(t)) & ~t.rlike(ARTICLE_HEADING) & ~t.rlike(ANNEX_HEADING) & ~t.rlike(DIVISION_MARK)


def line_kind(line: Column) -> Column:
    t = collapsed(line)
    return (F.when(t.rlike(ARTICLE_HEADING), "article").when(t.rlike(ANNEX_HEADING), "annex").when(t.rlike(DIVISION_MARK), F.lower(F.regexp_extract(t, DIVISION_MARK, 1)))
            .when(likely_division_title(t), "division_title").when(likely_article_title(t), "title").otherwise("text"))


def json_object(answer: Column) -> Column:
    """The widest braces in a model's answer, without its fences; null if they hold no JSON object."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^```(?:json)?\s*", ""), r"(?i)```\s*$", ""))
    return bound(F.regexp_extract(bare, r"(?s)\{.*\}", 0), lambda found: F.when((found != "") & F.get_json_object(found, "$").isNotNull(), found))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def json_entries(text: pd.Series) -> pd.Series:
    """Keys, trimmed, and values of a JSON object, a key's last value where it is repeated; null for what isn't one."""

    def entries(x: str | None) -> list | None:
        try:
            found = json.loads(x) if x else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(found, dict):
            return None
        said = {k.strip(): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items() if v is not None}
        return [{"key": k, "value": v} for k, v in said.items()]

    return text.map(entries)


def titles_by_key(answer: Column, valid: Column) -> Column:
    """Of a model's answer the entries whose keys are valid, as cleaned titles that aren't empty."""
    titles = F.transform(json_entries(json_object(answer)), lambda e: F.struct(e["key"].alias("key"), recital_title(e["value"]).alias("value")))
    kept = F.filter(titles, lambda e: F.array_contains(valid, e["key"]) & (e["value"] != ""))
    return F.map_from_entries(F.coalesce(kept, F.array().cast("array<struct<key: string, value: string>>")))


def is_formex(document: Column) -> Column:
    return document.contains("COMBINED.FMX") | (document.contains("<ACT") & F.lower(document).contains("formex") & document.contains("<ENACTING.TERMS"))


def payload_kind(payload: Column) -> Column:
    """What a stored law is: Formex or other XML, a combined document or an envelope around one, or something else."""
    bare = F.trim(payload)
    parsed = F.try_parse_json(bare)
    has = lambda path: F.try_variant_get(parsed, path, "variant").isNotNull()
    return (F.when(bare.startswith("<"), F.when(is_formex(bare), "formex").otherwise("xml")).when(has("$.articles"), "combined")
            .when(has("$.payload"), "envelope").otherwise("unknown"))


def document_language(html: Column) -> Column:
    """The language that a page's meta tag names, else that of its header cell, else English."""
    meta = attribute(first_match(html, r"""(?i)(<meta\b[^>]*name=["']WT\.z_usr_lan["'][^>]*>)"""), "content")
    cell = first_match(html, r"(?is)<p\b[^>]*class=\"[^\"]*\boj-hd-lg\b[^\"]*\"[^>]*>(.*?)</p>")
    code = lambda x: F.nullif(F.upper(F.trim(F.regexp_replace(x, "<[^>]*>", ""))), F.lit(""))
    return F.coalesce(code(meta), code(cell), F.lit("EN"))


def html_title(html: Column) -> Column:
    """An act's title in a page: from its meta tag, else from the first of three elements that has a usable one."""
    meta = attribute(first_match(html, r"""(?i)(<meta\b[^>]*name=["']WT\.z_docTitle["'][^>]*>)"""), "content")
    inner = lambda name: without_tags(F.regexp_extract(html, rf"""(?is)<[^>]+id=["']{name}["'][^>]*>(.*?)</[^>]+>""", 1))
    return F.coalesce(registry_title(decoded(meta)), *(registry_title(inner(name)) for name in ("englishTitle", "title", "originalTitle")))


def xml_title(xml: Column) -> Column:
    """The best of a document's title blocks: a type of act, a number, parentheses and length speak for one; the first wins ties."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<TITLE\b.*?</TITLE>"), F.lit(0))

    def candidate(block: Column, at: Column) -> Column:
        lines = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<TI\b[^>]*>(.*?)</TI>"), F.lit(1)), without_tags)
        title = registry_title(F.when(F.size(lines) > 0, F.trim(F.array_join(lines, " "))).otherwise(without_tags(block)))
        points = [F.when(title.rlike(p), n).otherwise(0) for p, n in ((r"(?i)\b(regulation|directive|decision)\b", 100), (r"\b\d{4}/\d+\b", 30), (r"\([^)]+\)", 15))]
        return F.struct((sum(points[1:], points[0]) + F.least(F.length(title), F.lit(200)) / 10).alias("score"), (-at).alias("place"), title.alias("title"))

    return F.array_max(F.filter(F.transform(blocks, candidate), lambda c: c["title"].isNotNull()))["title"]


def stream_text(log: Column) -> Column:
    """The text of a stream of events: the deltas of its ``data:`` lines, frame by frame; what was thought where nothing was said."""
    lines = F.transform(F.filter(F.split(F.replace(log, F.lit("\r"), F.lit("")), "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substr(x, F.lit(6))))
    frames = F.filter(lines, lambda x: F.try_parse_json(x).isNotNull())
    said = lambda name: F.array_join(F.transform(frames, lambda x: F.coalesce(F.get_json_object(x, f"$.choices[0].delta.{name}"), F.lit(""))), "")
    return F.coalesce(F.nullif(said("content"), F.lit("")), said("reasoning"))
