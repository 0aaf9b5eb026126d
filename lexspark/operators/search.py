"""Registry records, lookups and the ranked law search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import refs, text

# Other names of acts.
KNOWN_ALIASES = {
    "32000L0031": ["ecommerce", "e commerce", "e commerce directive", "ecommerce directive", "electronic commerce directive", "directive 2000/31"],
    "32016L0680": ["law enforcement directive", "led", "police directive", "directive 2016/680"],
    "32016R0679": ["gdpr", "general data protection regulation"],
    "32002L0058": ["eprivacy", "eprivacy directive", "directive on privacy and electronic communications", "privacy and electronic communications directive", "directive 2002/58"],
    "32018L1972": ["european electronic communications code", "eecc"], "32022R0868": ["data governance act"], "32022R1925": ["digital markets act"],
    "32022R2065": ["digital services act"], "32023R2854": ["data act"], "32024R1689": ["ai act", "artificial intelligence act"],
}
# Queries that stand for others.
QUERY_REWRITES = {
    "dma": "digital markets act", "dsa": "digital services act", "dora": "regulation 2022/2554", "nis2": "directive 2022/2555", "nis 2": "directive 2022/2555",
    "p2b": "regulation 2019/1150", "eidas": "regulation 2014/910", "ecommerce": "directive 2000/31", "e commerce": "directive 2000/31", "e commerce directive": "directive 2000/31",
    "ecommerce directive": "directive 2000/31", "eprivacy": "directive 2002/58", "law enforcement directive": "directive 2016/680", "led": "directive 2016/680",
    "police directive": "directive 2016/680", "digital governance act": "data governance act", "open data directive": "directive 2019/1024",
    "platform to business regulation": "regulation 2019/1150", "eprivacy directive": "directive 2002/58",
}


def bare(query: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if not "\u0300" <= c <= "\u036f")


def plain(query: str) -> str:
    return re.sub("[^a-z0-9]+", " ", bare(query)).strip()


def parsed_query(query: str, rewrite: bool = True) -> dict:
    """The one row that a query becomes; it is small, so literals carry it into the plan."""
    raw = QUERY_REWRITES.get(plain(query), query) if rewrite else query
    normal = plain(raw)
    small = normal.replace(" ", "")
    typed = re.search(r"\b(regulation|directive|decision)\b[^0-9]*(\d{4})\s*/\s*(\d{1,4})\b", bare(raw))
    slash = re.search(r"\b(\d{4})\s*/\s*(\d{1,4})\b", bare(raw))
    kind = re.search(r"\b(regulation|directive|decision)\b", bare(raw))
    celex = re.match(r"^3\d{4}[RLD]\d{1,4}$", small.upper())
    year, number = typed.groups()[1:] if typed else slash.groups() if slash else (None, None)
    return {
        "original": query, "normal": normal, "compact": small, "terms": [t for t in normal.split() if len(t) >= 2 and t not in text.LOW_SIGNAL_TERMS],
        "celex": celex and celex[0], "year": year, "number": number and str(int(number)), "type": kind and kind[1],
    }


def enriched(records: DataFrame) -> DataFrame:
    """Records with normalised fields, identifier parts, act kind and aliases."""
    known = F.create_map(*(x for k, v in KNOWN_ALIASES.items() for x in (F.lit(k), F.array(*(F.lit(plain(a)) for a in v)))))
    title = text.registry_title(F.col("title"))
    base = records.withColumns({
        "title": title, "n_title": text.normalized(title), "n_celex": F.lower("celex"), "n_eli": text.normalized(F.col("eli")), "kind": refs.eli_kind(F.col("eli")),
        "celex_year": refs.celex_year(F.col("celex")), "celex_number": refs.celex_number(F.col("celex")), "celex_type": refs.celex_type(F.col("celex")),
    })
    named = F.coalesce(F.try_element_at(known, F.col("celex")), F.array().cast("array<string>"))
    short = F.coalesce(text.acronym_variants(F.col("title")), F.array().cast("array<string>"))
    names = F.array_compact(F.concat(F.array("n_celex", "celex_type", F.concat_ws(" ", "celex_type", "n_celex"), "n_title"), short, named))
    both = F.concat(names, F.transform(F.filter(names, lambda x: F.length(x) >= 2), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
    return base.withColumns({"is_primary": (F.col("kind") == "primary") & ~refs.is_corrigendum(F.col("celex")), "aliases": F.filter(F.array_distinct(both), lambda x: x != "")})


def given(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def in_alias(term: str) -> Column:
    return F.exists("aliases", lambda a: a.contains(term))


def law_score(q: dict) -> Column:
    """The additive score of an enriched record for a parsed query."""
    col, lit = F.col, F.lit
    kind, original = col("celex_type"), q["original"].lower()
    title_c = F.replace(col("n_title"), lit(" "), lit(""))
    parts = [given(col("is_primary"), 120), given(col("kind") == "implementing", -180), given(col("kind") == "delegated", -180), given((col("kind") == "corrigendum") | refs.is_corrigendum(col("celex")), -300)]
    if not q["type"]:
        parts += [given(kind == "regulation", 30), given(kind == "directive", 25), given(kind == "decision", -40)]
    if re.search(r"\bact\b", q["normal"]):
        parts.append(given(kind == "decision", -80))
    if "directive" in original:
        parts += [given(kind == "directive", 80), given(kind == "regulation", -40)]
    if "regulation" in original:
        parts += [given(kind == "regulation", 80), given(kind == "directive", -40)]
    parts += [given(col("n_celex") == q["normal"], 200), given(F.array_contains("aliases", q["normal"]), 160), given(F.array_contains("aliases", q["compact"]), 180)]
    parts.append(F.when(col("n_title") == q["normal"], 140).when(col("n_title").contains(q["normal"]), 80).otherwise(0))
    parts.append(F.when(title_c == q["compact"], 140).when(title_c.contains(q["compact"]), 80).otherwise(0))
    if q["celex"]:
        parts.append(given(col("celex") == q["celex"], 600))
    same = []
    for name, points in (("type", 50), ("year", 70), ("number", 90)):
        if q[name]:
            same.append(col(f"celex_{name}") == q[name])
            parts.append(given(same[-1], points))
    if q["type"] and q["year"] and q["number"]:
        parts.append(given(same[0] & same[1] & same[2], 450))
    elif q["year"] and q["number"]:
        parts.append(given(same[-2] & same[-1], 250))
    for t in q["terms"]:
        parts += [given(col("n_title").contains(t), 12), given(col("n_eli").contains(t), 8), given(in_alias(t), 18), given(col("n_celex").contains(t), 25), given(title_c.contains(t), 8)]
    if len(q["terms"]) > 1:
        in_title = sum((given(col("n_title").contains(t), 1) for t in q["terms"]), lit(0))
        of_alias = sum((given(in_alias(t), 1) for t in q["terms"]), lit(0))
        parts += [in_title * 10, of_alias * 12, given(in_title == len(q["terms"]), 60), given(of_alias == len(q["terms"]), 70)]
    parts += [given(F.upper(col("celex")) == q["compact"].upper(), 200), given(F.replace(col("n_eli"), lit(" "), lit("")).contains(q["compact"]), 40)]
    return sum(parts[1:], parts[0])


def match_reason(q: dict) -> Column:
    reference = (F.col("celex_type") == q["type"]) & (F.col("celex_year") == q["year"]) & (F.col("celex_number") == q["number"]) if q["type"] and q["year"] and q["number"] else F.lit(False)
    small = F.replace(F.col("n_title"), F.lit(" "), F.lit(""))
    return (F.when(F.col("celex") == (q["celex"] or ""), "celex_exact").when(F.array_contains("aliases", q["normal"]) | F.array_contains("aliases", q["compact"]), "alias_exact")
            .when(reference, "reference_exact").when((F.col("n_title") == q["normal"]) | (small == q["compact"]), "title_exact")
            .when(F.col("n_title").contains(q["normal"]) | small.contains(q["compact"]), "title_phrase").otherwise("token_match"))


def law_search(records: DataFrame, query: str, limit: int = 10, rewrite: bool = True) -> DataFrame:
    """The best primary acts for a query: score, then date, then the registry's order; at most 50."""
    q = parsed_query(query, rewrite)
    scored = enriched(records).where("is_primary").withColumns({"score": law_score(q), "match_reason": match_reason(q)})
    order = [F.desc("score"), F.desc(F.coalesce("date", F.lit(""))), F.asc("ord")]
    return scored.where("score > 0").orderBy(*order).limit(max(1, min(limit or 10, 50))).select("celex", "title", "type", "date", "eli", "score", "match_reason")


def with_supplements(records: DataFrame, supplements: DataFrame) -> DataFrame:
    """Records and those supplements whose identifier they lack."""
    return records.unionByName(supplements.join(records.select("celex"), "celex", "left_anti"), allowMissingColumns=True)


def resolved(references: DataFrame, records: DataFrame) -> DataFrame:
    """References (year, number) resolved to a record if exactly one act type has them."""
    hits = records.groupBy(F.col("celex_year").alias("year"), F.col("celex_number").alias("number")).agg(F.countDistinct("celex").alias("hits"), F.min("celex").alias("celex"))
    state = F.when(F.col("hits") == 1, "resolved").when(F.col("hits") > 1, "ambiguous").otherwise("none")
    return references.join(hits, ["year", "number"], "left").select(*references.columns, state.alias("state"), F.when(F.col("hits") == 1, F.col("celex")).alias("celex"))


def rewritten(query: Column) -> Column:
    """The query that stands for a shorthand, else the query itself."""
    known = F.create_map(*(F.lit(x) for pair in QUERY_REWRITES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, text.normalized(query)), query)


def act_types_of(numbers: DataFrame, records: DataFrame) -> DataFrame:
    """Journal numbers (year, number) probed as every act type: accepted if exactly one has a record."""
    hits = records.groupBy("year", "number").agg(F.countDistinct("type").alias("n"), F.min("type").alias("type"))
    state = F.when(F.col("n") == 1, "accepted").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return numbers.join(hits, ["year", "number"], "left").select(*numbers.columns, state.alias("state"), F.when(F.col("n") == 1, F.col("type")).alias("type"))
