"""A reader's library: known laws from several sources, their references, addresses, freshness and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import refs


def library_laws(bundled: DataFrame, meta: DataFrame, cached: DataFrame) -> DataFrame:
    """Laws that were opened, latest first: those of ``meta`` and ``cached``, with what ``bundled`` says of them.

    bundled: celex, key, label; meta: celex, label, raw, added_at, last_opened; cached: key (identifier, ``_``, language).
    """
    keys = meta.select("celex").union(cached.select(F.substring_index("key", "_", 1).alias("celex"))).distinct()
    b, m = bundled.select("celex", F.col("key").alias("b_key"), F.col("label").alias("b_label")), meta.withColumnRenamed("label", "m_label")
    joined = keys.join(m, "celex", "left").join(b, "celex", "left")
    own = refs.celex_reference(F.col("celex"))
    slug = F.coalesce(F.col("b_key"), refs.reference_slug(own["act_type"], own["year"], own["number"]))
    return joined.where("last_opened > 0").select(
        "celex", F.coalesce("b_key", F.concat(F.lit("import:"), "celex")).alias("id"), F.when(F.col("b_key").isNotNull(), "bundled").otherwise("imported").alias("kind"),
        F.coalesce("m_label", "b_label", "raw", "celex").alias("label"), refs.law_route(slug, F.col("celex"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("en")).alias("route"),
        "last_opened", F.coalesce("added_at", F.lit(0)).alias("added_at"),
    ).orderBy(F.desc("last_opened"), F.desc("added_at"), "celex")


def stored_by_reference(asked: DataFrame, meta: DataFrame) -> DataFrame:
    """For each reference (act_type, year, number) the first stored row that has it and whose identifier agrees with it."""
    parts = ["act_type", "year", "number"]
    fresh = meta.where(refs.celex_agrees(F.col("celex"), F.col("act_type"), F.col("year"), F.col("number")))
    first = fresh.groupBy(*parts).agg(F.min_by("celex", "ord").alias("celex"))
    return asked.join(first, parts, "left")


def first_hit(asked: DataFrame, candidates: str, records: DataFrame, key: str) -> DataFrame:
    """Each row of ``asked`` with the record of the first of its candidates that has one."""
    tried = asked.select("id", F.posexplode(candidates).alias("place", key)).join(records, key)
    found = tried.groupBy("id").agg(F.min_by("celex", "place").alias("celex"), F.min("place").alias("place"))
    return asked.join(found, "id", "left")


def recency_label(ts: Column, as_of: Column) -> Column:
    """today, yesterday, the weekday within six days, else the date, with its year unless it is this one's."""
    days = F.datediff(as_of, ts)
    same_year = F.year(ts) == F.year(as_of)
    return (F.when(days == 0, "today").when(days == 1, "yesterday").when(days <= 6, F.date_format(ts, "EEEE"))
            .when(same_year, F.date_format(ts, "MMM d")).otherwise(F.date_format(ts, "MMM d, yyyy")))


def stale(entries: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Partial entries, and failed ones whose last failure is longer ago."""
    retry = F.col("last_failed").isNotNull() & (F.col("last_failed") < as_of - F.expr(f"interval {hours} hours"))
    return entries.where(F.col("partial") | retry)


def cases_with(cases: DataFrame, words: str, columns: list[str], lists: list[str]) -> DataFrame:
    """Cases that hold the words in one of the columns or in an entry of one of the lists."""
    q = words.lower()
    tests = [F.lower(c).contains(q) for c in columns] + [F.exists(c, lambda x: F.lower(x).contains(q)) for c in lists]
    found = tests[0]
    for t in tests[1:]:
        found = found | F.coalesce(t, F.lit(False))
    return cases.where(F.coalesce(found, F.lit(False)))


def heavy_hitters(rows: DataFrame, column: str, order: str, most: int = 1000) -> DataFrame:
    """The most frequent values; of equally frequent ones those seen last."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last"))
    return counts.orderBy(F.desc("n"), F.desc("last")).limit(most).select(column, "n")


def division_titles(lines: DataFrame, by: str, order: str, text: str, mark: Column, title: Column) -> DataFrame:
    """Lines that mark a division, with the next line as title where it looks like one."""
    w = Window.partitionBy(by).orderBy(order)
    return lines.withColumns({"is_mark": mark, "next": F.when(F.lead(title).over(w), F.lead(text).over(w))}).where("is_mark").select(by, order, F.col(text).alias("number"), F.col("next").alias("title"))


def bundle_recitals(links: DataFrame, articles: DataFrame, most: int = 6) -> DataFrame:
    """Recitals of the chosen articles (doc_id, article): the best score over articles, of which each gives ``most`` at most."""
    place = F.row_number().over(Window.partitionBy("doc_id", "article").orderBy(F.desc("score"), "recital"))
    return links.join(articles, ["doc_id", "article"], "left_semi").withColumn("place", place).where(F.col("place") <= most).groupBy("doc_id", "recital").agg(F.max("score").alias("score"))


def bundle_cases(references: DataFrame, act: str, articles: DataFrame) -> DataFrame:
    """Cases that cite one of the chosen articles of an act, with those references in order."""
    ref = F.concat_ws("/", "article", F.coalesce("paragraph", F.lit("")), F.coalesce("point", F.lit("")))
    return references.where(F.col("act") == act).join(articles, "article", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("n_refs"), F.array_join(F.array_sort(F.collect_list(ref)), " ").alias("refs"))


def definitions_within(units: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, pos, term) where a unit holds a term of its own law, of one word or several, anywhere."""
    return units.join(definitions.select("doc_id", "term"), "doc_id").where(F.lower("text").contains(F.lower("term"))).select("doc_id", "pos", "term").distinct()


def stopwords(lists: DataFrame, languages: DataFrame, base: str = "en") -> DataFrame:
    """(lang, word) of each language's own list and of the ``base`` language's, each word once; ``lists`` are (lang, word)."""
    shared = lists.where(F.col("lang") == base).agg(F.collect_set("word").alias("words"))  # one list
    common = languages.distinct().join(F.broadcast(shared)).select("lang", F.explode("words").alias("word"))
    return lists.select("lang", "word").union(common).distinct()
