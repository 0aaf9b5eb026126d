"""Judgments: declarations of the operative part, metadata and parties, in built-in functions over tidied pages.

Four layouts are tried in turn: numbered tables behind the paragraph of the grounds, paragraphs with the classes of older
pages, ``dt`` numbers, and numbers in the plain text. A page whose layout yields nothing falls to the next; a page without an
operative part, and a null page, has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import bold_name, bound, collapsed, decoded, first_match
from lexspark.sources import markup

col = F.col
# Grammar of judgments.
GROUNDS, RULES = r"(?i)^On\s+those\s+grounds", r"(?i)hereby\s+(rules|declares|orders)"
OPENINGS = (
    r"(?i)On\s+those\s+grounds\s*,?\s*the\s+Court\s*\([^()]*\)\s*hereby\s+(?:rules|declares|orders)\s*:?",
    r"(?i)On\s+those\s+grounds\s*,?\s*THE\s+COURT\s*(?:\([^()]*\))?\s*(?:hereby\s+)?(?:rules|declares|orders)\s*:?",
)
CLOSINGS = r"(?i)Delivered\s+in\s+open\s+court|Language\s+of\s+the\s+case"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
CASES = r"(?i)(?:In\s+)?(?:Joined\s+)?Cases?\s+(C[-‑–]\d+/\d{2,4}(?:\s*(?:and|,|to)\s*C[-‑–]\d+/\d{2,4})*+)"

# Loops over groups are possessive, so that Java's pattern engine doesn't follow them by recursion.
BLANK = r"(?:\s|&nbsp;|&#160;)*+"
NUMBERED_DT = rf"<dt\b[^>]*>{BLANK}\d+\.?{BLANK}</dt>"
COUNT = r"(?is)<[^>]*\bcoj-count\b[^>]*>\s*+(?:<[^>]*+>\s*+)*+(\d+)\."
BOLD_COUNT = r"(?is)<[^>]*\bcoj-count\b[^>]*\bcoj-bold\b|<[^>]*\bcoj-bold\b[^>]*\bcoj-count\b|<[^>]*\bcoj-count\b[^>]*>\s*<[^>]*\bcoj-bold\b"


def content(html: Column) -> Column:
    """Text of markup, white space collapsed."""
    return collapsed(decoded(F.regexp_replace(html, "<[^>]*>", "")))


def classed(name: str, tag: str = r"[a-z]\w*") -> str:
    """Pattern of an element with a class, up to the first end of such a tag."""
    return rf'(?is)<({tag})\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>.*?</\1>'


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match, null where there is none."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


def declaration(number: Column, text: Column) -> Column:
    return F.struct(number.try_cast("long").alias("number"), text.alias("text"))


def from_tables(html: Column) -> Column:
    """A table with a bold number begins a declaration, its last cell is the text; tables up to the next number add their
    first paragraph."""
    opening = F.get(F.filter(every(html, classed("coj-normal", "p")), lambda p: bound(content(p), lambda t: t.rlike(GROUNDS) & t.rlike(RULES))), F.lit(0))
    rest = bound(opening, lambda o: F.substr(html, F.position(o, html) + F.length(o)))
    area = F.get(F.split(rest, r'(?is)<[^>]*\bcoj-signaturecase\b|<hr\b[^>]*\bcoj-note\b', 2), F.lit(0))
    tables = every(area, r"(?is)<table\b.*?</table>")

    def part(t: Column) -> Column:
        number = F.when(t.rlike(BOLD_COUNT), first_match(t, COUNT))
        more = bound(content(F.regexp_extract(t, classed("coj-normal", "p"), 0)), lambda m: F.when(~m.rlike("(?i)^Delivered in open court"), m))
        return declaration(number, F.when(number.isNotNull(), content(F.regexp_replace(t, r"(?is)^.*<td\b[^>]*>", ""))).otherwise(more))

    nothing = F.expr("cast(array() as array<struct<number: bigint, text: string>>)")

    def add(done: Column, one: Column) -> Column:
        last = F.element_at(done, -1)
        joined = declaration(last["number"], F.trim(F.concat_ws(" ", last["text"], F.nullif(one["text"], F.lit("")))))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        return F.when(one["number"].isNotNull(), F.concat(done, F.array(one))).when(F.size(done) > 0, longer).otherwise(done)

    found = F.aggregate(F.transform(tables, part), nothing, add)
    return F.filter(found, lambda d: (d["number"] > 0) & (d["text"] != ""))


def from_classes(html: Column) -> Column:
    """Paragraphs of older pages; one without a number has its place as number."""
    texts = F.filter(F.transform(every(html, r'(?is)<p\b[^>]*\bclass="C0[89]Dispositif[^"]*"[^>]*>.*?</p>'), content), lambda t: t != "")
    numbered = r"^(\d+)\.\s*(.+)$"
    return F.transform(texts, lambda t, i: F.when(t.rlike(numbered), declaration(F.regexp_extract(t, numbered, 1), F.regexp_extract(t, numbered, 2))).otherwise(declaration(i + 1, t)))


def from_terms(html: Column) -> Column:
    """``dt`` numbers behind the ruling; a declaration ends at the next number or table."""
    found = every(after(html, RULES), rf"(?is){NUMBERED_DT}.*?(?={NUMBERED_DT}|<table\b|\z)")
    both = F.transform(found, lambda d: declaration(F.regexp_extract(d, rf"(\d+)\.?{BLANK}</dt>", 1), F.regexp_replace(content(d), r"^\d+\.\s*", "")))
    return F.filter(both, lambda d: d["text"] != "")


def from_text(html: Column) -> Column:
    """Numbers in the text between the opening and the closing words; without numbers all of it is one declaration."""
    number = r"(?:^|\s)(\d+)\.\s+"

    def points(ruling: Column) -> Column:
        some = bound(F.split(ruling, number, -1), lambda t: F.zip_with(every(ruling, number, 1), F.slice(t, F.lit(2), F.size(t)), lambda n, x: declaration(n, F.trim(x))))
        return bound(some, lambda d: F.when(F.size(d) > 0, d).otherwise(F.array(declaration(F.lit(1), ruling))))

    ruling = bound(content(html), lambda whole: F.trim(F.get(F.split(F.coalesce(*(after(whole, p) for p in OPENINGS)), CLOSINGS, 2), F.lit(0))))
    return F.filter(bound(ruling, points), lambda d: d["text"] != "")


def declarations(judgments: DataFrame) -> DataFrame:
    """doc_id, ordinal from 1, number and text of the declarations of ``judgments`` (doc_id, html). No shuffle."""
    judgments = judgments.select("doc_id", markup.tidied("html").alias("html"))
    # Held in an array, so that a layout is read once for its test and its rows.
    found = F.coalesce(*(F.get(F.filter(F.array(f(col("html"))), lambda d: F.size(d) > 0), F.lit(0)) for f in (from_tables, from_classes, from_terms, from_text)))
    one = judgments.select("doc_id", found.alias("d")).select("doc_id", F.posexplode("d").alias("i", "d"))
    return one.select("doc_id", (col("i") + 1).cast("long").alias("ordinal"), "d.number", "d.text")


def parties(html: Column) -> Column:
    """The first two names in bold type with a v between them, or the one there is: spans, else older paragraphs, else the
    first bold font that isn't a case number."""
    spans = every(html, r'<span class="(?:coj-)?bold">([^<]+)</span>', 1)
    older = F.flatten(F.transform(every(html, r'(?is)<p\s+class="C02AlineaAlt[^"]*"[^>]*>(.*?)</p>', 1), lambda p: every(p, "(?is)<b>(.*?)</b>", 1)))
    fonts = F.transform(every(html, r'(?is)<font[^>]+class="[^"]*oj-font[^"]*"[^>]*>\s*<b>([^<]*+(?:<(?!/b>)[^<]*+)*+)</b>\s*</font>', 1), lambda f: F.regexp_replace(f, r"(?i)<br\s*/?>", " "))
    named = lambda found: F.transform(found, bold_name)
    font = F.slice(F.filter(named(fonts), lambda n: (n != "") & ~n.rlike(r"(?i)^Case\s+[CT]-\d")), 1, 1)
    some = lambda found, other: bound(found, lambda x: F.when(F.size(x) > 0, named(x)).otherwise(other))
    both = lambda n: F.struct(*(F.nullif(F.get(n, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(("first", "second"))))
    versus = lambda p: F.when(p["first"].isNotNull() & p["second"].isNotNull(), F.concat(p["first"], F.lit(" v "), p["second"])).otherwise(p["first"])
    return bound(bound(some(spans, some(older, font)), both), versus)


def metadata(judgments: DataFrame) -> DataFrame:
    """doc_id, formation, date, subject, case_number, ecli and parties of ``judgments`` (doc_id, html); null where a page
    doesn't say."""
    judgments = judgments.select("doc_id", markup.tidied("html").alias("html"))
    html, whole, titles = col("html"), col("whole"), col("titles")
    judgments = judgments.select("doc_id", "html", content(html).alias("whole"), F.transform(every(html, classed("coj-sum-title-1")), content).alias("titles"))
    dated = rf"\d{{1,2}} (?:{MONTHS}) \d{{4}}"
    date = F.get(F.filter(F.transform(titles, lambda t: F.regexp_extract(t, dated, 0)), lambda d: d != ""), F.lit(0))
    return judgments.select(
        "doc_id",
        first_match(F.get(titles, F.lit(0)), r"(?i)\(([^)]*Chamber|full Court)\)").alias("formation"),
        date.alias("date"),
        F.nullif(content(F.regexp_extract(html, classed("coj-index"), 0)), F.lit("")).alias("subject"),
        F.regexp_replace(first_match(whole, CASES), "[‑–]", "-").alias("case_number"),
        first_match(whole, r"(ECLI:EU:C:\d{4}:\d+)").alias("ecli"),
        parties(html).alias("parties"),
    )
