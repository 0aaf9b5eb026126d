"""Texts and inputs for a model: the index of a law, what a summary is made from, and a bundle with a question.

Every part is ordered lines of one law, gathered per law and joined; each text in it has its own budget of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import without_tags_or_references
from lexspark.operators.citations import top_counts

col = F.col
# Budgets of characters and counts.
ARTICLE_TEXT, RECITAL_TEXT, RECITALS, CANDIDATES = 1200, 700, 8, 12


def dashed(first: Column, second: Column) -> Column:
    """``first — second``, without the dash where there is no second part."""
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.coalesce(F.concat(F.lit(" — "), F.nullif(second, F.lit(""))), F.lit(""))))


def cut(text: Column, most: int) -> Column:
    bare = without_tags_or_references(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) > most, F.concat(F.rtrim(F.substring(bare, 1, most)), F.lit("..."))).otherwise(bare)


def skeletons(articles: DataFrame, focus: str | None = None) -> DataFrame:
    """law and skeleton: chapters and sections in the order in which they first appear, each with its articles.

    articles: law, ordinal, number, title, chapter, chapter_title, section, section_title. Divisions are told apart by their
    numbers; their titles are those of their first articles; articles outside of divisions stand in groups without a line.
    """
    chapter, section = ["law", "chapter"], ["law", "chapter", "section"]
    firsts = lambda key, title: (F.min("ordinal").over(Window.partitionBy(*key)), F.min_by(title, "ordinal").over(Window.partitionBy(*key)))
    (c_at, c_title), (s_at, s_title) = firsts(chapter, "chapter_title"), firsts(section, "section_title")
    placed = articles.withColumns({"c_at": c_at, "c_title": c_title, "s_at": s_at, "s_title": s_title})
    mark = F.when(col("number") == F.lit(focus), "   ← focus").otherwise("")
    lines = F.array(
        F.struct(col("c_at"), F.lit(-1).cast("long").alias("s_at"), F.lit(-1).cast("long").alias("at"), F.when(col("ordinal") == col("c_at"), dashed(col("chapter"), col("c_title"))).alias("line")),
        F.struct(col("c_at"), col("s_at"), F.lit(-1).cast("long").alias("at"), F.when(col("ordinal") == col("s_at"), dashed(col("section"), col("s_title"))).alias("line")),
        F.struct(col("c_at"), col("s_at"), col("ordinal").alias("at"), F.concat(F.lit("    "), dashed(F.concat(F.lit("Art. "), "number"), col("title")), mark).alias("line")),
    )
    rows = placed.select("law", F.explode(lines).alias("l")).where("l.line <> ''")
    return rows.groupBy("law").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("skeleton"))


def summary_inputs(articles: DataFrame, recitals: DataFrame, mentions: DataFrame) -> DataFrame:
    """law, articles (number, title, text), recitals (number, text) and candidates (label, n) that a summary is made from.

    articles: law, ordinal, number, title, text; recitals: law, ordinal, number, text; mentions: law, label, one row for each
    reference to another act. Articles and recitals without number or text are left out, of the recitals the first eight
    count; candidates are the twelve most mentioned, then by label.
    """
    with_text = lambda rows, most: rows.withColumn("text", cut(col("text"), most)).where("trim(number) <> '' and text <> ''")
    own = with_text(articles, ARTICLE_TEXT).groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ordinal", "number", "title", "text"))).alias("articles"))
    place = F.row_number().over(Window.partitionBy("law").orderBy("ordinal"))
    early = with_text(recitals.withColumn("place", place).where(col("place") <= RECITALS), RECITAL_TEXT)
    reasons = early.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ordinal", "number", "text"))).alias("recitals"))
    candidates = top_counts(mentions, "law", "label", CANDIDATES).groupBy("law").agg(F.array_sort(F.collect_list(F.struct("place", "label", "n"))).alias("candidates"))
    drop = lambda c, *names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    joined = own.join(reasons, "law", "left").join(candidates, "law", "left")
    return joined.select("law", drop("articles", "number", "title", "text").alias("articles"), drop("recitals", "number", "text").alias("recitals"), drop("candidates", "label", "n").alias("candidates"))


def bundle_prompts(bundles: DataFrame, question: Column) -> DataFrame:
    """law and prompt: a row of ``grounded.bundles`` as text, with the question at its end."""

    def section(title: str, items: Column, line) -> Column:
        lines = F.flatten(F.array(F.array(F.lit(title)), F.flatten(F.transform(items, lambda x: F.array_compact(F.array(*line(x))))), F.array(F.lit(""))))
        return F.when(F.size(items) > 0, lines).otherwise(F.array().cast("array<string>"))

    def cited(r: Column) -> Column:
        part = lambda x: F.coalesce(F.concat(F.lit("("), F.nullif(x, F.lit("")), F.lit(")")), F.lit(""))
        return F.concat(F.lit("Art. "), r["number"], part(r["paragraph"]), part(r["point"]))

    def case(c: Column) -> list[Column]:
        name, date = F.concat(F.lit("— "), F.nullif(c["name"], F.lit(""))), F.concat(F.lit("("), F.nullif(c["date"], F.lit("")), F.lit(")"))
        return [F.concat_ws(" ", c["celex"], name, date), F.concat(F.lit("  Matching refs: "), F.array_join(F.transform(c["refs"], cited), ", "))]

    none = lambda name: F.coalesce(col(name), F.slice(name, 1, 0))
    texts = F.flatten(F.transform("articles", lambda a: F.array(F.concat(F.lit("["), dashed(F.concat(F.lit("ARTICLE "), a["number"]), a["title"]), F.lit("]")), F.coalesce(a["text"], F.lit("")), F.lit(""))))
    no_cases = F.array(*map(F.lit, ("[CJEU CASE LAW]", "No CJEU judgments in the bundle cite the provided articles.", "")))
    head = F.array(F.concat(F.lit("[LAW] "), col("law").cast("string")), F.concat(F.lit("[ARTICLES PROVIDED] "), F.array_join(F.transform("articles", lambda a: a["number"]), ", ")), F.lit(""))
    lines = F.flatten(F.array(
        head, texts, section("[DEFINITIONS USED IN THESE ARTICLES]", none("definitions"), lambda d: [F.concat(F.lit('"'), d["term"], F.lit('": '), F.coalesce(d["definition"], F.lit("")))]),
        section("[RELATED RECITALS]", none("recitals"), lambda r: [F.concat(F.lit("Recital "), r["recital"].cast("string"), F.lit(": "), F.coalesce(r["text"], F.lit("")))]),
        F.when(F.size("cases") > 0, section("[CJEU CASE LAW (cases citing any of the provided articles)]", col("cases"), case)).otherwise(no_cases), F.array(F.lit("[QUESTION]"), question),
    ))
    return bundles.select("law", F.array_join(lines, "\n").alias("prompt"))
