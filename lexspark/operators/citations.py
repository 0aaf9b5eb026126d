"""Citations: long forms to compact ones, structured references, case lookups, back-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import refs
from lexspark.functions.text import bound

# Acts that are cited by name, and the grammar of citations in judgments.
NAMED_ACTS = ["GDPR", "Charter", "TFEU", "TEU", "ECHR"]
_ONE = r"Articles?\s+\d+(?:\(\d+\))*(?:\([a-z]\))?\s+of\s+"
_MANY = r"Articles\s+[\d,\s]+(?:and\s+\d+)?\s+of\s+"
_ACT = r"(?:Regulation|Directive|Decision)\s+\(?(?:EU|EC|EEC|Euratom)?\)?\s*(?:No\s+)?\d{2,4}/\d+"
_NAME = r"(?:the\s+)?(?:GDPR|Charter|TFEU|TEU|ECHR)"
CITATION_PATTERNS = [f"(?i){p}" for p in (_ONE + _ACT, _ONE + r"(?:Regulation|Directive|Decision)\s+\d{2,4}/\d+", _ONE + _NAME, _MANY + _ACT, _MANY + _NAME, r"Article\s+\d+(?:\(\d+\))?\s+(?:TFEU|TEU|ECHR)")]


def pill(citation: Column) -> Column:
    """``Article 6(1) of Regulation (EU) 2016/679`` to ``Art. 6(1) GDPR``."""
    label = F.regexp_replace(citation, r"(?i)^Articles?\s+", "Art. ")
    act = r"(?is)\s+of\s+(?:Regulation|Directive|Decision)\s+\(?(?:EU|EC|EEC|Euratom)?\)?\s*(?:No\s+)?"
    of = lambda name: rf"(?is)\s+of\s+(?:the\s+)?{name}"

    def short(x: Column) -> Column:
        named = F.when(F.lit(False), x)
        for name in NAMED_ACTS:
            named = named.when(x.rlike(of(name)), F.regexp_replace(x, of(name) + ".*$", f" {name}"))
        return (F.when(x.rlike(of(f"(?:{'|'.join(NAMED_ACTS)})")), named).when(x.rlike(act + r"2016/679(?!\d)"), F.regexp_replace(x, act + r"2016/679(?!\d).*$", " GDPR"))
                .otherwise(F.regexp_replace(x, act + r"(\d{2,4}/\d+).*$", " $1")))

    return bound(label, short)


def article_citations(text: Column) -> Column:
    """Citations of articles in a judgment's text as written: those of each pattern in turn, each once whatever its case."""
    all_of = lambda clean: F.flatten(F.array(*(F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for p in CITATION_PATTERNS)))
    once = lambda found: bound(F.transform(found, F.lower), lambda low: F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
    return F.transform(bound(bound(F.trim(F.regexp_replace(text, r"\s+", " ")), all_of), once), lambda x: F.trim(x))


def structured(pills: DataFrame, key: list[str], column: str = "pill") -> DataFrame:
    """One row per different article token of each compact citation, composites split: act, act_celex, article, paragraph,
    point, and at, the place of the token's first mention. A citation's tokens are told apart in its own array: no shuffle."""
    form = r"^Art\.?\s+(.+?)\s+([A-Za-z]+|\d{2,4}/\d+)\s*$"
    tokens = F.split(F.regexp_replace(F.regexp_extract(column, form, 1), r"(?i)\s+and\s+", ", "), ",")

    def parts(token: Column) -> Column:
        return bound(F.trim(token), lambda t: F.struct(*(c.alias(n) for n, c in zip(("article", "paragraph", "point"), refs.article_parts(t)))))

    def once(all_parts: Column) -> Column:
        placed = F.transform(all_parts, lambda p, i: F.struct(i.alias("at"), p.alias("p")))
        return F.filter(placed, lambda e: e["p"]["article"].isNotNull() & (F.array_position(all_parts, e["p"]) == e["at"] + 1))

    # What has no such form has no article. The outer explode keeps the optimiser from working the array out for a filter too.
    rows = pills.select(*key, F.regexp_extract(column, form, 2).alias("act"), F.explode_outer(bound(F.transform(tokens, parts), once)).alias("__one"))
    found = rows.where(F.col("__one").isNotNull())
    return found.select(*key, "act", refs.act_celex(F.col("act")).alias("act_celex"), "__one.p.article", "__one.p.paragraph", "__one.p.point", "__one.at")


def cases_for_article(structured_refs: DataFrame, case: str, act: str, article: str) -> DataFrame:
    return structured_refs.where((F.col("act") == act) & (F.col("article") == article)).select(case).distinct()


def expanded_ranges(ranges: DataFrame, most: int = 50) -> DataFrame:
    """Rows (src, first, last) to one row per article of the range; of wider ranges only the first is known to be meant."""
    span = F.when((F.col("last") >= F.col("first")) & (F.col("last") - F.col("first") <= most), F.sequence("first", "last")).otherwise(F.array("first"))
    return ranges.select("src", F.explode(span).alias("article"))


def back_references(edges: DataFrame) -> DataFrame:
    """For each act the laws that refer to it, without itself."""
    return edges.where("law <> act").groupBy("act").agg(F.countDistinct("law").alias("n_sources"), F.min("law").alias("first_source"))


def external_overview(edges: DataFrame) -> DataFrame:
    """For each act how often it is referred to and the kind of the first reference."""
    return edges.groupBy("act").agg(F.count(F.lit(1)).alias("n"), F.min_by("kind", F.struct("law", "ord", "kind")).alias("first_kind"))


def top_related(edges: DataFrame, most: int = 12) -> DataFrame:
    return external_overview(edges).orderBy(F.desc("n"), "act").limit(most)


def definitions_used(units: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document holds a definition's term as a word; a term is one token, so it is an equi-join."""
    words = units.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term"))
    return words.join(definitions, "term").select("doc_id", "item_id").distinct()


def top_counts(rows: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """Per ``by`` the ``most`` frequent values with their number n and place; equally frequent ones in their own order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where(F.col("place") <= most)
