"""Acts as pages in any of four layouts: which one a page has, and its recitals, articles, annexes and definitions.

A page is read by the first layout that it has marks of and that yields a unit: structured, legacy, proposal, flat. All plans
work on the blocks of ``markup`` and keep the rows of a page together; windows and groups are keyed by page, so none is larger
than one page.

Beyond the pages' own grammar: an article's text are the paragraphs from its heading to the next heading in its subdivision, so
articles that share one, and subdivisions around others, don't repeat text; a paragraph that merely begins like an annex's
heading is one only outside of subdivisions; a table within a table is part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import languages
from lexspark.functions.text import ANNEX_HEADING, ARTICLE_HEADING, DIVISION_MARK, likely_article_title, likely_division_title
from lexspark.operators.structure import in_doc, so_far
from lexspark.sources import flat_laws, markup, proposals
from lexspark.sources.stored import bucketed, stored

col = F.col
UNIT = ["doc_id", "kind", "ordinal", "number", "title", "chapter", "section", "text"]
# Classes of divisions, and what headings and recitals of the legacy layout say.
DIVISION, DIVISION_TITLE = ["title-division-1", "oj-ti-section-1"], ["title-division-2", "oj-ti-section-2"]
ANNEX_NUMBER, WHEREAS, NUMBERED = r"(?i)^ANNEX\s*([IVXLC]+|\d+)?", r"(?i)^Whereas:?$", r"^\((\d+)\)\s*(.*)$"


def has_class(*names: str) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, names)))


def one_of(window_column: str):
    return Window.partitionBy("doc_id", window_column).orderBy("pos")


def layout_names(blocks: DataFrame) -> DataFrame:
    """doc_id and the name of the first layout that a page has marks of."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.get(F.first("layouts"), F.lit(0)), F.lit("flat")).alias("layout"))


def worded(blocks: DataFrame, lang: str) -> DataFrame:
    """Blocks with the patterns of their page's language, which is ``lang`` where the page names none that is known."""
    own = F.when(F.upper("lang").isin(*languages.WORDS), F.upper("lang")).otherwise(languages.known(lang))
    return blocks.withColumn("language", own).join(F.broadcast(languages.table(blocks.sparkSession)), "language")


def matches(text: Column, form: str) -> Column:
    return F.regexp_instr(text, col(form)) > 0


def extract(text: Column | str, form: str) -> Column:
    """Group 1 of the first match of a pattern that stands in a column; '' without one."""
    return F.call_function("regexp_extract", F.col(text) if isinstance(text, str) else text, col(form), F.lit(1))


def carried(lines: DataFrame, chapter: Column, section: Column) -> DataFrame:
    """``lines`` with the latest chapter and section; a chapter ends the section."""
    marked = lines.withColumns({"chapter": chapter, "section": F.when(chapter.isNotNull(), "").otherwise(section)})
    return marked.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in ("chapter", "section")}).withColumn("section", F.nullif("section", F.lit("")))


def numbered(units: DataFrame) -> DataFrame:
    """Units with their ordinal by place within their kind."""
    return units.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos")).cast("long"))


def structured(blocks: DataFrame) -> DataFrame:
    """Units from pages with subdivisions (``blocks`` with patterns)."""
    text, own = col("text"), blocks.where("tag <> 'meta'")
    p = col("tag") == "p"
    by_text = (col("root") == 0) & matches(text, "annex_form")
    kind = F.when(col("heading") & ~has_class(*markup.ANNEX), "article").when(col("heading") | (p & by_text), "annex")
    rows = own.withColumns({"kind": kind, "division": p & has_class(*DIVISION), "its_title": p & has_class(*DIVISION_TITLE)})

    # A division's heading waits for the next one of the two kinds; only a title can be taken.
    either = Window.partitionBy("doc_id", "named").orderBy("pos")
    lines = rows.where("division or its_title or tag in ('p', '#text') and text <> '' and not recital")
    named = lines.withColumn("named", col("division") | col("its_title")).withColumn("follows", F.when(F.lead("its_title").over(either), F.lead("text").over(either)))
    label = F.concat_ws(" — ", "text", F.nullif("follows", F.lit("")))
    of_section = ~matches(text, "chapter_form") & matches(text, "section_form")
    divided = carried(named, F.when(col("division") & ~of_section, label), F.when(col("division") & of_section, label))

    # Lines belong to the latest heading in their subdivision; those before the first one to it.
    in_root = Window.partitionBy("doc_id", "root").orderBy("pos")
    head_pos = F.last(F.when(col("kind").isNotNull(), col("pos")), ignorenulls=True).over(in_root.rowsBetween(Window.unboundedPreceding, 0))
    first_pos = F.min(F.when(col("kind").isNotNull(), col("pos"))).over(Window.partitionBy("doc_id", "root"))
    paragraphs = divided.where("not division and not its_title")
    # An annex's heading that is one by its words has its title in the paragraph after it.
    by_words = F.struct("title", (col("kind").isNotNull() & ~col("heading")).alias("by_words"))
    latest = F.last(F.when(p, by_words), ignorenulls=True).over(in_root.rowsBetween(Window.unboundedPreceding, -1))
    headed = paragraphs.withColumns({"latest": latest, "head_pos": head_pos, "first_pos": first_pos})
    said = p & col("latest.by_words") & (col("latest.title") == text)
    placed = headed.withColumns({"head_pos": F.coalesce("head_pos", F.when(col("root") > 0, col("first_pos"))), "said": F.coalesce(said, F.lit(False))})
    head = F.min(F.when(col("kind").isNotNull(), F.struct("pos", "root", "kind", "text", "title", "chapter", "section", "article_form", "annex_form", "definition_form")))
    body = F.array_sort(F.collect_list(F.when(col("kind").isNull() & ~col("titled") & ~col("said"), F.struct("pos", "text"))))
    units = numbered(placed.where("head_pos is not null").groupBy("doc_id", "head_pos").agg(head.alias("head"), body.alias("lines")).select("doc_id", "head.*", "lines"))
    number, annex = (F.nullif(extract(text, form), F.lit("")) for form in ("article_form", "annex_form"))
    annex_title = F.concat_ws(" — ", text, F.nullif("title", F.lit("")))
    is_article = col("kind") == "article"
    laid = units.select(
        "doc_id", "pos", "root", "kind", "ordinal", F.when(is_article, F.coalesce(number, text)).otherwise(F.coalesce(annex, annex_title)).alias("number"),
        F.when(is_article, F.coalesce("title", F.lit(""))).otherwise(annex_title).alias("title"), F.when(is_article, col("chapter")).alias("chapter"), F.when(is_article, col("section")).alias("section"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), "definition_form",
    )
    defined = cell_definitions(rows)
    return laid.select(*UNIT).unionByName(structured_recitals(own), allowMissingColumns=True).unionByName(defined, allowMissingColumns=True)


def structured_recitals(blocks: DataFrame) -> DataFrame:
    """The first two cells of a recital's subdivision are its number and its text; recitals are in the order of their numbers."""
    cells = blocks.where("tag in ('td', 'th') and recital").withColumn("place", F.row_number().over(one_of("root")))
    cell = lambda k: F.max(F.when(col("place") == k, col("text")))
    both = cells.where("place <= 2").groupBy("doc_id", "root").agg(cell(1).alias("mark"), cell(2).alias("text")).where("text is not null")
    at = Window.partitionBy("doc_id").orderBy("root")
    number = F.coalesce(F.nullif(F.regexp_extract("mark", r"(\d+)", 1), F.lit("")), F.nullif("mark", F.lit("")), F.row_number().over(at).cast("string"))
    value = F.coalesce(F.regexp_replace("number", r"\D+", "").try_cast("decimal(38,0)"), F.lit(0))
    found = both.withColumn("number", number)
    order = Window.partitionBy("doc_id").orderBy(value, "root")
    return found.select("doc_id", F.lit("recital").alias("kind"), F.row_number().over(order).cast("long").alias("ordinal"), "number", "text")


def cell_definitions(rows: DataFrame) -> DataFrame:
    """Terms (as title) and definitions (as text) in the second cells of the tables of the first article whose title says that it
    defines them (``rows``: blocks with kind, division and its_title)."""
    # Headings are read with the tables, so that no article is put together for its title.
    article = (col("kind") == "article") & col("tag").isin("p", "#text") & (col("text") != "") & ~col("recital") & ~col("division") & ~col("its_title")
    defining = F.coalesce(article & matches(col("title"), "definition_form"), F.lit(False))
    of_them = rows.where("tag in ('table', 'td') or heading").withColumn("defining", defining).where("tag in ('table', 'td') or defining")
    number = F.when(col("defining"), F.coalesce(F.nullif(extract("text", "article_form"), F.lit("")), col("text")))
    first = F.min(F.when(col("defining"), F.struct("pos", "root", number.alias("number")))).over(Window.partitionBy("doc_id"))
    in_table = F.last(F.when(col("tag") == "table", col("pos")), ignorenulls=True).over(so_far())
    tables = of_them.withColumns({"of": first, "table": in_table}).where("tag = 'td'")
    second = tables.withColumn("place", F.row_number().over(one_of("table"))).where("place = 2").where(matches(col("text"), "cell_form"))
    term, meaning = F.trim(extract("text", "cell_form")), F.trim(F.regexp_replace("text", col("cell_form"), F.lit("")))
    found = second.where("root = of.root and root > 0").select("doc_id", "pos", F.lit("definition").alias("kind"), "of.number", term.alias("title"), meaning.alias("text"))
    return numbered(found).drop("pos")


def legacy(blocks: DataFrame) -> DataFrame:
    """Units from pages of paragraphs and tables with classes: a heading begins an article or annex, what stands before the
    first one are recitals, and those without a number count on."""
    text, p = col("text"), col("tag") == "p"
    rows = blocks.where("tag in ('p', 'table') and text <> ''")
    article = has_class("ti-art") | text.rlike(ARTICLE_HEADING)
    doc_title = has_class("doc-ti")
    annex = ~article & doc_title & text.rlike(ANNEX_HEADING)
    seen = rows.withColumns({"article": article, "annex": annex, "doc_title": doc_title, "mark": text.rlike(DIVISION_MARK), "capitals": likely_division_title(text, clean=True)})
    before = lambda c: F.coalesce(F.lag(c).over(in_doc()), F.lit(False))
    subtitle = before("annex") & p & col("doc_title") & ~text.rlike(ANNEX_HEADING) & ~text.rlike(ARTICLE_HEADING)
    seen = seen.withColumn("subtitle", subtitle).withColumn("division", col("mark") & ~col("article") & ~col("annex") & ~col("subtitle"))
    seen = seen.withColumn("bare", col("division") & (F.regexp_extract(text, DIVISION_MARK, 3) == ""))
    seen = seen.withColumn("named", before("bare") & p & col("capitals"))
    after = lambda c: F.when(F.lead(c).over(in_doc()), F.lead("text").over(in_doc()))
    seen = seen.withColumns({"follows": F.coalesce(after("named"), after("subtitle")), "starts": col("article") | col("annex")})
    word, own = F.upper(F.regexp_extract(text, DIVISION_MARK, 1)), F.nullif(F.regexp_extract(text, DIVISION_MARK, 3), F.lit(""))
    label = F.concat_ws(" — ", F.concat(word, F.lit(" "), F.regexp_extract(text, DIVISION_MARK, 2)), F.coalesce(own, F.when(col("bare"), col("follows"))))
    divided = carried(seen, F.when(col("division") & (word != "SECTION"), label), F.when(col("division") & (word == "SECTION"), label))
    counted = divided.withColumn("unit", F.sum(col("starts").cast("int")).over(so_far())).where("not division and not named and not subtitle")

    head = F.min(F.when(col("starts"), F.struct("pos", "text", "article", "chapter", "section", "follows")))
    titled = ~col("starts") & p & ~col("doc_title") & likely_article_title(text) & ~col("capitals")
    body = F.array_sort(F.collect_list(F.when(~col("starts"), F.struct("pos", "text"))))
    grouped = counted.where("unit > 0").groupBy("doc_id", "unit").agg(head.alias("head"), F.min(F.when(titled, F.struct("pos", "text"))).alias("titled"), body.alias("body"))
    units = grouped.select("doc_id", "head.*", F.when(col("head.article"), col("titled")).alias("titled"), "body").withColumn("kind", F.when(col("article"), "article").otherwise("annex"))
    lines = F.transform(F.filter("body", lambda b: col("titled").isNull() | (b["pos"] != col("titled.pos"))), lambda b: b["text"])
    annex_title = F.concat_ws(" — ", "text", "follows")
    number = F.nullif(F.regexp_extract("text", r"(?i)Article\s+(\d+[A-Za-z]*)", 1), F.lit(""))
    annex_number = F.nullif(F.regexp_extract("text", ANNEX_NUMBER, 1), F.lit(""))
    articles = numbered(units).withColumn("body", lines).select(
        "doc_id", "pos", "kind", "ordinal", F.when(col("article"), F.coalesce(number, col("ordinal").cast("string"))).otherwise(F.coalesce(annex_number, annex_title)).alias("number"),
        F.when(col("article"), F.coalesce("titled.text", F.lit(""))).otherwise(annex_title).alias("title"), F.when(col("article"), col("chapter")).alias("chapter"), F.when(col("article"), col("section")).alias("section"),
        F.array_join("body", "\n").alias("text"),
    )

    # Before the first heading a line is no subtitle, and a division's title is in capitals.
    start = F.min(F.when(article | annex, col("pos"))).over(Window.partitionBy("doc_id"))
    opening = rows.withColumn("start", start).where("start is null or pos < start").where(p & ~doc_title & ~text.rlike(DIVISION_MARK) & ~text.rlike(WHEREAS) & ~likely_division_title(text, clean=True))
    opening = opening.where(text.rlike(NUMBERED) | has_class("normal", "note"))
    given = F.when(text.rlike(NUMBERED), F.regexp_extract(text, NUMBERED, 1))
    runs = opening.withColumn("given", given).withColumn("run", F.count("given").over(so_far()))
    place = F.row_number().over(one_of("run")) - F.when(col("run") > 0, 1).otherwise(0)
    last_given = F.first("given").over(one_of("run")).try_cast("long")
    counted_on = (F.coalesce(last_given, F.lit(0)) + place).cast("string")
    recital = F.when(col("given").isNotNull(), F.regexp_extract(text, NUMBERED, 2)).otherwise(text)
    recitals = numbered(runs.select("doc_id", "pos", F.lit("recital").alias("kind"), F.coalesce("given", counted_on).alias("number"), recital.alias("text")))
    return articles.drop("pos").unionByName(recitals.drop("pos"), allowMissingColumns=True)


def line_definitions(units: DataFrame) -> DataFrame:
    """Definitions in lettered lines of the articles among ``units`` (whose texts are lines joined by \\n) as units."""
    articles = units.where("kind = 'article' and layout <> 'structured'").withColumn("body", F.split("text", "\n"))
    found = flat_laws.definitions(articles, "layout").withColumn("pos", col("ordinal") * (1 << 32) + col("place")).drop("ordinal")
    return numbered(found.select("doc_id", "layout", "pos", F.lit("definition").alias("kind"), col("term").alias("title"), col("definition").alias("text"))).drop("pos")


def proposal(blocks: DataFrame) -> DataFrame:
    lines = proposals.classed_lines(blocks)
    return proposals.units(lines.drop("classes", "mark")).unionByName(proposals.recitals(lines), allowMissingColumns=True)


def flat(blocks: DataFrame) -> DataFrame:
    lines = flat_laws.text_lines(blocks)
    articles = flat_laws.articles(lines)
    units = articles.withColumns({"kind": F.lit("article"), "text": F.array_join("body", "\n")}).drop("body")
    recitals = flat_laws.recitals(lines).withColumn("kind", F.lit("recital"))
    return units.unionByName(recitals, allowMissingColumns=True)


def parsed(pages: DataFrame, lang: str = "EN") -> DataFrame:
    """doc_id, layout and the columns of ``UNIT`` of the recitals, articles, annexes and definitions of ``pages`` (doc_id,
    html); ``lang`` holds where a page doesn't name its language. Null pages and pages without units have no rows."""
    marks = F.coalesce(F.nullif(F.array_join("layouts", " "), F.lit("")), F.lit("none"))
    blocks = bucketed(markup.blocks(pages).withColumn("marks", marks), "page_blocks", "doc_id", "pos", "marks")  # walked and shuffled once

    def read(name: str, parse) -> DataFrame:
        return parse(blocks.where(F.array_contains(F.split("marks", " "), name))).select(*UNIT, F.lit(name).alias("layout"))

    found = read("structured", lambda b: structured(worded(b, lang)))
    for name, parse in (("legacy", legacy), ("proposal", proposal)):
        found = found.unionByName(read(name, parse))
    # Each layout is read once, and definitions in lines from what was read; only pages with marks of several, or that have no unit by their marks, are looked at again.
    found = stored(found, "page-units")
    ids = blocks.select("doc_id", "marks").distinct()
    several = stored(ids.where("marks like '% %'").select("doc_id"), "page-ids")
    place = F.array_position(F.array(*map(F.lit, ("structured", "legacy", "proposal"))), col("layout"))
    if not several.isEmpty():
        chosen = found.join(several, "doc_id").withColumn("first", F.min(place).over(Window.partitionBy("doc_id"))).where(place == col("first")).drop("first")
        found = found.join(several, "doc_id", "left_anti").unionByName(chosen)
    unread = stored(ids.where("marks <> 'none'").join(found.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id"), "page-ids")
    plain = blocks.where("marks = 'none'")
    if not unread.isEmpty():
        plain = plain.unionByName(blocks.where("marks <> 'none'").join(unread, "doc_id", "left_semi"))
    found = found.unionByName(stored(flat(plain).select(*UNIT, F.lit("flat").alias("layout")), "page-units"))
    return found.unionByName(line_definitions(found), allowMissingColumns=True).select("doc_id", "layout", *UNIT[1:])
