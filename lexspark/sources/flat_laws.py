"""Laws without structural markup: paragraphs of a page, grouped under headings by windows over their order.

Paragraphs are (doc_id, pos, text) with the white space collapsed and none empty. As windows and groups are keyed by document
or article, none is larger than one document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import ARTICLE_HEADING, DIVISION_MARK, collapsed, likely_article_title, likely_division_title
from lexspark.operators.structure import in_doc, so_far
from lexspark.sources import markup

col = F.col
# Grammar of recitals and definitions.
WHEREAS, NUMBERED = r"(?i)^Whereas:?$", r"^\((\d+)\)\s*(.*)$"
LETTERED = r"(?i)^\([a-z]\)\s+(.*)$"
QUOTED_MEANS, MEANS = r"""(?i)^["“'‘]?([^"”'’]+)["”'’]?\s+means\s+(.+)$""", r"(?i)^(.+?)\s+means\s+(.+)$"


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, pos and text of the paragraphs of ``pages`` (doc_id, html), numbered from 1: those of the text element, or of
    the whole page where it has none. Null pages and pages without paragraphs have no rows."""
    return text_lines(markup.blocks(pages)).withColumn("pos", F.row_number().over(in_doc()).cast("long"))


def text_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, pos and text of the paragraphs among a page's blocks, those of the text element alone where it has some."""
    whole = Window.partitionBy("doc_id")
    lines = blocks.where("tag = 'p' and text <> ''").select("doc_id", "pos", "text", "fragment", F.max("fragment").over(whole).alias("has"))
    return lines.where("fragment or not has").select("doc_id", "pos", "text")


def articles(lines: DataFrame) -> DataFrame:
    """doc_id, ordinal, number, title, chapter, section and body (an array) of the articles in ``lines``.

    An article reaches to the next heading. Its title is its first line that looks like one; a division's title follows its
    mark, on the same line or in capitals on the next. A chapter ends the section; divisions before the first article don't
    count.
    """
    text, mark = col("text"), col("text").rlike(DIVISION_MARK)
    own = F.regexp_extract(text, DIVISION_MARK, 3)
    kind = F.when(mark, F.lower(F.regexp_extract(text, DIVISION_MARK, 1)))
    classified = lines.select(
        "doc_id", "pos", "text", kind.alias("kind"), likely_division_title(text, clean=True).alias("capitals"), (mark & (own == "")).alias("bare"), own.alias("own"),
        F.sum(text.rlike(ARTICLE_HEADING).cast("int")).over(so_far()).alias("ordinal"),
    ).where("ordinal > 0")
    following = F.when(F.lead("capitals").over(in_doc()), F.lead("text").over(in_doc()))
    seen = classified.withColumns({"taken": col("capitals") & F.coalesce(F.lag("bare").over(in_doc()), F.lit(False)), "following": following})
    number = F.concat(F.upper("kind"), F.lit(" "), F.regexp_extract(text, DIVISION_MARK, 2))
    named = F.concat_ws(" — ", number, F.nullif(F.when(col("bare"), col("following")).otherwise(col("own")), F.lit("")))
    of_section = col("kind") == "section"
    # A chapter sets the section to '', so that the latest value holds for both.
    divided = seen.withColumns({"chapter": F.when(~of_section, named), "section": F.when(of_section, named).when(~of_section, "")})
    carried = divided.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in ("chapter", "section")}).where("kind is null and not taken")
    heading = text.rlike(ARTICLE_HEADING)
    titled = ~heading & likely_article_title(text) & ~col("capitals")
    line = F.struct("pos", "text")
    grouped = carried.groupBy("doc_id", "ordinal").agg(
        F.min(F.when(heading, F.struct("pos", "text", "chapter", F.nullif("section", F.lit("")).alias("section")))).alias("head"),
        F.min(F.when(titled, line)).alias("titled"), F.array_sort(F.collect_list(F.when(~heading, line))).alias("body"),
    )
    body = F.filter("body", lambda b: col("titled").isNull() | (b["pos"] != col("titled")["pos"]))
    return grouped.select(
        "doc_id", col("ordinal").cast("long").alias("ordinal"), F.regexp_extract("head.text", r"(\d+[A-Za-z]*)$", 1).alias("number"), col("titled")["text"].alias("title"),
        col("head")["chapter"].alias("chapter"), col("head")["section"].alias("section"), F.transform(body, lambda b: b["text"]).alias("body"),
    )


def definitions(found: DataFrame, *more: str) -> DataFrame:
    """doc_id, ordinal, ``more`` of the columns, place, term and definition from the lettered lines of articles whose title speaks of definitions."""
    lines = found.where("title rlike '(?i)definition'").select("doc_id", "ordinal", *more, F.posexplode("body").alias("i", "line"))
    entry = F.regexp_extract("line", LETTERED, 1)
    term = F.when(entry.rlike(QUOTED_MEANS), F.regexp_extract(entry, QUOTED_MEANS, 1)).otherwise(F.regexp_replace(F.trim(F.regexp_extract(entry, MEANS, 1)), "^[\"“'‘]|[\"”'’]$", ""))
    meaning = F.when(entry.rlike(QUOTED_MEANS), F.regexp_extract(entry, QUOTED_MEANS, 2)).otherwise(F.regexp_extract(entry, MEANS, 2))
    out = lines.select("doc_id", "ordinal", *more, (col("i") + 1).cast("long").alias("place"), F.trim(term).alias("term"), F.regexp_replace(F.trim(meaning), ";$", "").alias("definition"))
    return out.where("term <> '' and definition <> ''")


def recitals(lines: DataFrame) -> DataFrame:
    """doc_id, ordinal, number and text of the numbered recitals between the line that says Whereas and the first article;
    none in a document without both."""
    text = col("text")
    first = lambda form: F.min(F.when(text.rlike(form), col("pos"))).over(Window.partitionBy("doc_id"))
    inside = lines.withColumns({"opened": first(WHEREAS), "ended": first(ARTICLE_HEADING)}).where("pos > opened and pos < ended")
    numbered = inside.withColumn("ordinal", F.sum(text.rlike(NUMBERED).cast("int")).over(so_far())).where("ordinal > 0")
    part = F.struct("pos", F.when(text.rlike(NUMBERED), F.regexp_extract(text, NUMBERED, 2)).otherwise(text).alias("text"))
    grouped = numbered.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.when(text.rlike(NUMBERED), F.regexp_extract(text, NUMBERED, 1))).alias("number"))
    return grouped.select("doc_id", col("ordinal").cast("long").alias("ordinal"), "number", collapsed(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text"))
