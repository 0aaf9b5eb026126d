"""Identifiers and references as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import first_match, unpadded

# Act shorthands and their identifiers.
ACT_CELEX = {
    "GDPR": "32016R0679", "2016/679": "32016R0679", "95/46": "31995L0046", "2002/58": "32002L0058", "2016/680": "32016L0680",
    "2022/2065": "32022R2065", "2022/1925": "32022R1925", "2024/1689": "32024R1689", "Charter": "12012P", "TFEU": "12012E", "TEU": "12012M",
}
CELEX = r"^\d{5}[A-Z]{1,2}\d{4}(?:\([0-9]+\))?$"


def is_celex(text: Column) -> Column:
    return text.rlike(CELEX)


def celex_year(celex: Column) -> Column:
    return first_match(celex, r"^3(\d{4})[RLD]0*\d{1,4}", 1)


def celex_number(celex: Column) -> Column:
    return first_match(celex, r"^3\d{4}[RLD]0*(\d{1,4})", 1)


def celex_type(celex: Column) -> Column:
    mark = F.substring(celex, 6, 1)
    return F.when(mark == "R", "regulation").when(mark == "L", "directive").when(mark == "D", "decision").otherwise("unknown")


def is_corrigendum(celex: Column) -> Column:
    return celex.rlike(r"\(\d+\)$")


def eli_kind(eli: Column) -> Column:
    path = F.lower(eli)
    return (F.when(path.rlike(r"/eli/(reg|dir|dec)/\d{4}/\d+/oj$"), "primary").when(path.contains("/reg_impl/"), "implementing")
            .when(path.contains("/reg_del/"), "delegated").when(path.contains("/corrigendum/"), "corrigendum").otherwise("other"))


def eli_key(eli: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(eli), "/+$", ""), "^https:", "http:"))


def act_type(text: Column) -> Column:
    return first_match(F.lower(text), r"\b(regulation|directive|decision)\b", 1)


def reference_year(text: Column) -> Column:
    return F.coalesce(first_match(text, r"\b(\d{4})/(\d{1,4})\b", 1), first_match(text, r"(?i)\bno\s+(\d{1,4})/(\d{4})\b", 2))


def reference_number(text: Column) -> Column:
    return F.coalesce(first_match(text, r"\b(\d{4})/(\d{1,4})\b", 2), first_match(text, r"(?i)\bno\s+(\d{1,4})/(\d{4})\b", 1))


def full_year(two_or_four: Column) -> Column:
    n = two_or_four.try_cast("int")
    return F.when(F.length(two_or_four) == 2, F.when(n >= 50, 1900 + n).otherwise(2000 + n).cast("string")).otherwise(two_or_four)


def official_year_number(text: Column) -> tuple[Column, Column]:
    """Year and number of an official citation: year first where it is plausible, old short forms too."""
    a, b = first_match(text, r"\b(\d{4})/(\d{1,4})", 1), first_match(text, r"\b(\d{4})/(\d{1,4})", 2)
    c, d = first_match(text, r"(?i)\bno\.?\s+(\d{1,4})/(\d{2,4})", 1), first_match(text, r"(?i)\bno\.?\s+(\d{1,4})/(\d{2,4})", 2)
    e, f = first_match(text, r"\b(\d{1,4})/(\d{2,4})", 1), first_match(text, r"\b(\d{1,4})/(\d{2,4})", 2)
    plausible = a.try_cast("int").between(1950, 2100)
    year = F.when(plausible, a).when(a.isNotNull(), full_year(b)).when(d.isNotNull(), F.when(F.length(d) == 2, F.concat(F.lit("19"), d)).otherwise(d)).otherwise(full_year(e))
    number = F.when(plausible, b).when(a.isNotNull(), a).when(d.isNotNull(), c).otherwise(f)
    return year, number


def official_ref_key(kind: Column, year: Column, number: Column) -> Column:
    return F.when(number.rlike(r"^\d+$"), F.concat_ws("|", kind, year, unpadded(number)))


def case_to_celex(number: Column) -> Column:
    n, y = first_match(number, r"^C-(\d+)/(\d{2})$", 1), first_match(number, r"^C-(\d+)/(\d{2})$", 2)
    century = F.when(y.try_cast("int") > 50, "19").otherwise("20")
    return F.when(n.isNotNull(), F.concat(F.lit("6"), century, y, F.lit("CJ"), F.lpad(n, 4, "0"))).otherwise(number)


def celex_to_case(celex: Column) -> Column:
    y, n = first_match(celex, r"^6\d{2}(\d{2})CJ0*(\d+)$", 1), first_match(celex, r"^6\d{2}(\d{2})CJ0*(\d+)$", 2)
    return F.when(n.isNotNull(), F.concat(F.lit("C-"), n, F.lit("/"), y)).otherwise(celex)


def act_celex(act: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ACT_CELEX.items() for x in pair))
    return F.try_element_at(known, act)


def article_parts(token: Column) -> tuple[Column, Column, Column]:
    """Article, paragraph and point of a token such as ``6(1)(a)``; null where it is none."""
    ok = F.trim(token).rlike(r"^\d+[a-z]?(\([^)]+\))*$")
    take = lambda pattern: F.when(ok, first_match(F.trim(token), pattern, 1))
    return take(r"^(\d+[a-z]?)"), take(r"\((\d+[a-z]?)\)"), F.lower(take(r"\(([A-Za-z]+)\)"))


# The journal's site, the store of resources, and the letters of act types there.
SITE, STORE = "https://eur-lex.europa.eu", "http://publications.europa.eu/resource/eli"
ELI_TYPES = {"reg": "regulation", "dir": "directive", "dec": "decision"}


def extracted_celex(text: Column) -> Column:
    """The first identifier behind ``CELEX:`` or ``CELEX%3A``, in capitals."""
    number = r"(\d{5}[A-Z]{1,2}\d{4}(?:\([0-9]+\))?)"
    return F.upper(F.coalesce(first_match(text, f"(?i)CELEX[:%]3A{number}"), first_match(text, f"(?i)CELEX:{number}")))


def url_class(url: Column) -> Column:
    """celex, eli, oj, com or html for an address of the journal's site; null for others and for what is no address."""
    address = F.try_parse_url(url, F.lit("HOST"))
    uri = F.coalesce(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("uri"))), F.lit(""))
    eli = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(r"/eli/(reg|dir|dec)/\d{4}/\d{1,4}(/|$)")
    kind = (F.when(extracted_celex(url).isNotNull(), "celex").when(eli, "eli").when(uri.rlike(r"(?i)^OJ:[A-Z][_:]\d{4}[_:]?\d{1,5}"), "oj")
            .when(uri.rlike(r"(?i)^(COM|JOIN|SEC|SWD):\d{4}:\d{1,4}:\w+$"), "com").otherwise("html"))
    return F.when(address == SITE.removeprefix("https://"), kind)


def comnat_id(kind: Column, year: Column, number: Column, suffix: Column) -> Column:
    """The store's name of a preparatory document; null if a part is missing."""
    n = number.try_cast("int").cast("string")
    padded = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    return F.concat(F.lit("comnat:"), F.nullif(kind, F.lit("")), F.lit("_"), F.nullif(year, F.lit("")), F.lit("_"), padded, F.lit("_"), F.nullif(suffix, F.lit("")))


def eli_candidates(kind: Column, year: Column, number: Column, suffix: Column) -> Column:
    """Addresses under which an act may be stored, in the order in which they are tried; none if a part is missing."""
    n = number.try_cast("int").cast("string")
    at = lambda path, end="": F.concat(F.lit(f"{STORE}/{path}/"), year, F.lit("/"), n, F.lit(f"{end}/oj"))
    decision = F.array(F.when(suffix == "JHA", at("dec_framw")), at("dec"), at("dec", "(1)"))
    one = F.when(kind == "directive", F.array(at("dir"))).when(kind == "regulation", F.array(at("reg"))).when(kind == "decision", decision)
    return F.array_compact(F.coalesce(one, F.array().cast("array<string>")))


def act_link(celex: Column, lang: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/legal-content/"), F.upper(search_language(lang)), F.lit("/TXT/?uri=CELEX:"), celex)


def journal_link(series: Column, year: Column, number: Column, lang: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/legal-content/"), F.upper(search_language(lang)), F.lit("/TXT/?uri=OJ:"), series, F.lit(":"), year, F.lit(":"), number, F.lit(":TOC"))


def proposal_link(kind: Column, year: Column, number: Column, suffix: Column, lang: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/legal-content/"), F.upper(search_language(lang)), F.lit("/TXT/?uri="), F.concat_ws(":", kind, year, number, suffix))


def search_link(words: Column, lang: Column) -> Column:
    """A quick search without its time stamp; null without words."""
    return F.concat(F.lit(f"{SITE}/search.html?scope=EURLEX&text="), F.url_encode(F.nullif(words, F.lit(""))), F.lit("&lang="), search_language(lang), F.lit("&type=quick"))


def celex_reference(celex: Column) -> Column:
    """(act_type, year, number) that an identifier stands for; null where it is none of an act."""
    form = r"^3(\d{4})([RLD])0*(\d{1,4})(?:\(\d+\))?$"
    return F.when(celex.rlike(form), F.struct(celex_type(celex).alias("act_type"), F.regexp_extract(celex, form, 1).alias("year"), unpadded(F.regexp_extract(celex, form, 3)).alias("number")))


def celex_agrees(celex: Column, act_type: Column, year: Column, number: Column) -> Column:
    own = celex_reference(celex)
    return F.coalesce((own["act_type"] == act_type) & (own["year"] == year) & (own["number"] == number), F.lit(False))


def reference_slug(act_type: Column, year: Column, number: Column) -> Column:
    """``type-year-number``; null unless all parts are well-formed."""
    ok = act_type.isin(*ELI_TYPES.values()) & year.rlike(r"^\d{4}$") & number.rlike(r"^\d{1,4}$")
    return F.when(ok, F.concat_ws("-", act_type, year, number))


def slug_reference(slug: Column) -> Column:
    form = r"^(regulation|directive|decision)-(\d{4})-(\d{1,4})$"
    return F.when(slug.rlike(form), F.struct(*(F.regexp_extract(slug, form, k).alias(n) for k, n in enumerate(("act_type", "year", "number"), 1))))


def law_route(slug: Column, celex: Column, kind: Column, unit: Column, locale: Column) -> Column:
    """The page of a law or of one of its units; laws without a slug are opened by identifier; English has no prefix."""
    unit_path = F.when((kind != "overview") & unit.isNotNull(), F.concat(F.lit("/"), kind, F.lit("/"), F.url_encode(unit)))
    prefix = F.when(F.coalesce(locale, F.lit("en")) == "en", "/").otherwise(F.concat(F.lit("/"), locale, F.lit("/")))
    by_slug = F.concat(prefix, slug, F.coalesce(unit_path, F.lit("")))
    by_celex = F.concat(F.lit("/import"), F.coalesce(unit_path, F.lit("")), F.lit("?celex="), F.url_encode(F.nullif(F.upper(F.trim(celex)), F.lit(""))))
    return F.coalesce(by_slug, by_celex, F.lit("/"))


def known_celex(label: Column) -> Column:
    """The identifier of the first known act, in the dictionary's order, that a label names."""
    escape = lambda x: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", x)
    tests = []
    for name, celex in ACT_CELEX.items():
        bounded = label.rlike(f"(?i)(^|[^A-Za-z0-9/]){escape(name)}([^A-Za-z0-9/]|$)")
        tests.append(F.when(F.lower(label).contains(name.lower()) | bounded if "/" in name else bounded, celex))
    return F.coalesce(*tests)


# Languages of the journal by their two letters.
LANGUAGES = {
    "BG": "BUL", "CS": "CES", "DA": "DAN", "DE": "DEU", "EL": "ELL", "EN": "ENG", "ES": "SPA", "ET": "EST", "FI": "FIN", "FR": "FRA", "GA": "GLE", "HR": "HRV",
    "HU": "HUN", "IT": "ITA", "LT": "LIT", "LV": "LAV", "MT": "MLT", "NL": "NLD", "PL": "POL", "PT": "POR", "RO": "RON", "SK": "SLK", "SL": "SLV", "SV": "SWE",
}


def valid_language(lang: Column) -> Column:
    code = F.upper(F.coalesce(F.nullif(lang, F.lit("")), F.lit("ENG")))
    return F.when(code.isin(*LANGUAGES.values()), code)


def search_language(lang: Column) -> Column:
    """The first two letters of a code of three."""
    return F.lower(F.substring(F.coalesce(F.nullif(lang, F.lit("")), F.lit("ENG")), 1, 2))


def api_language(two_letters: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(two_letters)), F.lit("ENG"))


def truncated_ip(ip: Column) -> Column:
    """An address without what tells one machine from another: 24 bits of IPv4, mapped or not, 64 bits of IPv6."""
    bare = F.regexp_replace(ip, "%.*$", "")
    v4 = first_match(bare, r"(?i)^(?:::ffff:)?(\d+\.\d+\.\d+)\.\d+$")
    missing = F.lit(9) - F.size(F.split(bare, ":"))  # groups that :: stands for
    filled = F.when(bare.contains("::"), F.concat(F.substring_index(bare, "::", 1), F.repeat(F.lit(":"), missing), F.lit(":"), F.substring(bare, F.locate("::", bare) + 2, F.length(bare)))).otherwise(bare)
    v6 = F.concat(F.array_join(F.slice(F.split(filled, ":"), 1, 4), ":"), F.lit("::"))
    return F.when(ip.isNull() | (ip == "") | (ip == "unknown"), "unknown").when(v4.isNotNull(), F.concat(v4, F.lit(".0"))).when(bare.contains(":"), v6).otherwise(bare)


def external_year_number(target: Column) -> tuple[Column, Column]:
    """Year and number of a reference in a document: a part of four digits is the year (the first one before the second),
    else the first part is a two-digit year; parts of three digits have no year."""
    whole = r"(?i)^(\d{2,4})/(\d+)(?:/[A-Z]+)?$"
    a, b = first_match(target, whole, 1), first_match(target, whole, 2)
    year = F.when(F.length(a) == 4, a).when(F.length(b) == 4, b).when(F.length(a) == 2, full_year(a))
    number = F.when(F.length(a) == 4, b).when(F.length(b) == 4, a).when(F.length(a) == 2, b)
    return year, number


def article_mentions(text: Column) -> Column:
    """(first, last) of every mention of an article or of a range of articles; ``and`` makes a range too."""
    pattern = F.lit(r"(?i)\barticles?\s+(\d+)(?:\s+(?:to|and)\s+(\d+))?")
    firsts, lasts = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.try_cast("long").alias("first"), F.coalesce(b.try_cast("long"), a.try_cast("long")).alias("last")))
