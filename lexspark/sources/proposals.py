"""Proposals in the markup of preparatory documents, where a paragraph's class says what it is.

Lines are (doc_id, pos, kind, text): kind is enacting, annex, article, heading or null. As windows and groups are keyed by
document, none is larger than one document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import DIVISION_MARK
from lexspark.operators.structure import in_doc, so_far
from lexspark.sources import markup

col = F.col
# Classes of paragraphs, and the grammar of headings and recitals.
KINDS = {"Formuledadoption": "enacting", "Annexetitre": "annex", "Titrearticle": "article", "SectionTitle": "heading"}
TITLE_CLASSES = ["Statut", "Typedudocument", "Titreobjet"]
ARTICLE, ANNEX = r"(?i)^Article\s+(\d+[A-Za-z]*)\s*(.*)$", r"(?i)^ANNEX\s*([IVXLCDM]+|\d+)?"


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, pos, classes, mark (its own number), kind and text of the paragraphs of ``pages`` (doc_id, html) that have text.
    Null pages have no rows."""
    return classed_lines(markup.blocks(pages))


def classed_lines(blocks: DataFrame) -> DataFrame:
    kind = F.coalesce(*(F.when(F.array_contains("classes", name), kind) for name, kind in KINDS.items()))
    return blocks.where("tag = 'p' and text <> ''").select("doc_id", "pos", "classes", "mark", kind.alias("kind"), "text")


def titles(lines: DataFrame) -> DataFrame:
    """doc_id and title: the first paragraph of each of the title's classes."""
    # Only the texts that may be parts of it are grouped.
    candidates = lines.select("doc_id", *(F.when(F.array_contains("classes", c), F.struct("pos", "text")).alias(c) for c in TITLE_CLASSES))
    return candidates.groupBy("doc_id").agg(F.concat_ws(" ", *(F.min(c)["text"] for c in TITLE_CLASSES)).alias("title"))


def recitals(lines: DataFrame) -> DataFrame:
    """doc_id, kind, ordinal, number and text of the recitals in the order of their numbers; one without a number has its place."""
    own = lines.where(F.array_contains("classes", "li") & F.array_contains("classes", "ManualConsidrant"))
    number = F.coalesce(F.nullif(F.regexp_extract("mark", r"(\d+)", 1), F.lit("")), F.row_number().over(in_doc()).cast("string"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(col("number").try_cast("decimal(38,0)"), F.lit(0)), "pos")
    return own.withColumn("number", number).select(
        "doc_id", F.lit("recital").alias("kind"), F.row_number().over(order).cast("long").alias("ordinal"), "number", F.trim(F.regexp_replace("text", r"^\(\d+\)\s*", "")).alias("text")
    )


def units(lines: DataFrame) -> DataFrame:
    """doc_id, kind, ordinal, number, title, chapter, section and text (lines joined by \\n) of articles and annexes.

    Headings count from the enacting formula, the first article or the first annex on. One that marks a division ends the
    article, but not an annex; without a title of its own it takes that of the next heading before an article or annex. A
    chapter ends the section.
    """
    text = col("text")
    is_in = lambda *kinds: F.coalesce(col("kind").isin(*kinds), F.lit(False))
    opened = lines.withColumns({"starts": is_in("annex", "article"), "heading": is_in("heading") & F.max(is_in("annex", "article", "enacting")).over(so_far())})
    marked = opened.withColumn("mark", col("heading") & text.rlike(DIVISION_MARK))
    counted = marked.withColumns({"part": F.sum((col("mark") | col("starts")).cast("int")).over(so_far()), "unit": F.sum(col("starts").cast("int")).over(so_far())})
    following = F.min(F.when(col("heading") & ~col("mark"), F.struct("pos", "text"))).over(Window.partitionBy("doc_id", "part"))["text"]
    word, own = F.upper(F.regexp_extract(text, DIVISION_MARK, 1)), F.nullif(F.regexp_extract(text, DIVISION_MARK, 3), F.lit(""))
    named = F.concat_ws(" — ", F.concat(word, F.lit(" "), F.regexp_extract(text, DIVISION_MARK, 2)), F.coalesce(own, following))
    # A chapter sets the section to '', so that the latest value holds for both.
    divided = counted.withColumns({
        "chapter": F.when(col("mark") & (word != "SECTION"), named),
        "section": F.when(col("mark"), F.when(word == "SECTION", named).otherwise("")),
    })
    carried = divided.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in ("chapter", "section")}).where("unit > 0")
    head = F.min(F.when(col("starts"), F.struct("pos", "kind", "text", "part", "chapter", F.nullif("section", F.lit("")).alias("section"))))
    body = F.array_sort(F.collect_list(F.when(col("kind").isNull(), F.struct("pos", "part", "text"))))
    grouped = carried.groupBy("doc_id", "unit").agg(head.alias("head"), body.alias("body")).select("doc_id", "head.*", "body")
    article = col("kind") == "article"
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos")).cast("long")
    inside = F.filter("body", lambda b: ~article | (b["part"] == col("part")))
    number = lambda form: F.nullif(F.regexp_extract(text, form, 1), F.lit(""))
    return grouped.withColumn("ordinal", ordinal).select(
        "doc_id", "kind", "ordinal", F.when(article, F.coalesce(number(ARTICLE), col("ordinal").cast("string"))).otherwise(F.coalesce(number(ANNEX), text)).alias("number"),
        F.when(article, F.regexp_extract(text, ARTICLE, 2)).otherwise(text).alias("title"), F.when(article, col("chapter")).alias("chapter"), F.when(article, col("section")).alias("section"),
        F.array_join(F.transform(inside, lambda b: b["text"]), "\n").alias("text"),
    )


def parsed(pages: DataFrame) -> DataFrame:
    """Recitals, articles and annexes of proposals (doc_id, html)."""
    lines = paragraphs(pages)
    return units(lines.drop("classes", "mark")).unionByName(recitals(lines), allowMissingColumns=True)
