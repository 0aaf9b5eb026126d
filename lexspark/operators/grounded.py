"""Models' answers held against what a law and its cases really have, and the bundle of texts that a question is asked of.

An answer is JSON with typed parts inside; parts of another type than asked for count as missing. What may be cited is
gathered per law (its article numbers, up to a dozen instruments) or per article (its cases), so each group is a law's own
short list, and citations are checked in arrays beside the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import bound, json_object, without_tags_or_references

col = F.col
# How much of each part of an answer is kept.
TEXT, STRUCTURE, LABEL, RELATIONSHIP, SUMMARY, NAME = 900, 1000, 220, 320, 1200, 120
OBLIGATIONS, INSTRUMENTS, THEMES, CITES = 8, 6, 6, 6


def said(text: Column, most: int) -> Column:
    """Text without markup, cut to ``most`` characters; '' for null."""
    bare = without_tags_or_references(F.coalesce(text, F.lit("")))
    return bound(bare, lambda b: F.when(F.length(b) > most, F.concat(F.trim(F.substring(b, 1, most)), F.lit("..."))).otherwise(b))


def first(array: Column, most: int) -> Column:
    return F.slice(array, 1, most)


def cited_block(raw: Column, valid: Column, needs_citation: bool = False) -> Column:
    """(text, citations): an object's text with those of its citations that are valid, each once; a bare text has none. Null
    without a text, or without a citation where one is needed."""

    def block(own: Column) -> Column:
        cited = F.transform(F.coalesce(own["citations"], F.array().cast("array<string>")), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^Art\.?\s*", "")))
        citations = F.array_distinct(F.filter(cited, lambda c: F.array_contains(valid, c)))
        text = said(F.when(raw.startswith("{"), own["text"]).otherwise(raw), TEXT)
        return F.struct(text.alias("text"), citations.alias("citations"))

    kept = lambda b: F.when((b["text"] != "") & (F.lit(not needs_citation) | (F.size(b["citations"]) > 0)), b)
    return bound(bound(F.from_json(F.when(raw.startswith("{"), raw), "text string, citations array<string>"), block), kept)


def known_instruments(raw: Column, candidates: Column) -> Column:
    """Related instruments (label, celex, relationship) that are among the candidates by identifier or else by label."""

    def read(own: Column) -> Column:
        return F.struct(said(own["label"], LABEL).alias("label"), F.nullif(said(own["celex"], 40), F.lit("")).alias("celex"), said(own["relationship"], RELATIONSHIP).alias("relation"))

    def known(x: Column) -> Column:
        last = lambda test: F.try_element_at(F.filter(candidates, test), F.lit(-1))
        match = F.coalesce(last(lambda c: c["celex"] == x["celex"]), last(lambda c: F.lower(c["label"]) == F.lower(x["label"])))
        kept = lambda found: F.struct(found["label"].alias("label"), F.coalesce(found["celex"], x["celex"]).alias("celex"), x["relation"].alias("relationship"))
        return bound(match, lambda found: F.when((x["label"] != "") & (x["relation"] != "") & found.isNotNull(), kept(found)))

    def one(x: Column) -> Column:
        return bound(bound(F.from_json(x, "label string, celex string, relationship string"), read), known)

    return first(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), one), lambda x: x.isNotNull()), INSTRUMENTS)


def grounded_summaries(answers: DataFrame, articles: DataFrame, instruments: DataFrame) -> DataFrame:
    """law, purpose, scope, key_obligations, structure, related_instruments and error of ``answers`` (law, answer).

    articles: law, number; instruments: law, ordinal, label, celex. An answer without JSON, purpose, cited scope, cited
    obligation or structure has the first of these as ``error`` and no parts; a null answer has no JSON.
    """
    valid = articles.where("number is not null").groupBy("law").agg(F.collect_set("number").alias("valid"))
    listed = instruments.where("label is not null").groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "celex"))).alias("candidates"))
    beside = answers.join(valid, "law", "left").join(listed, "law", "left")
    shape = "purpose string, scope string, keyObligations array<string>, structure string, relatedInstruments array<string>"
    parsed = beside.withColumns({"json": json_object(col("answer")), "valid": F.coalesce("valid", F.array().cast("array<string>"))}).withColumn("a", F.from_json("json", shape))
    blocks = F.transform(F.coalesce("a.keyObligations", F.array().cast("array<string>")), lambda x: cited_block(x, col("valid"), True))
    candidates = F.coalesce("candidates", F.array().cast("array<struct<ordinal: bigint, label: string, celex: string>>"))
    parts = parsed.withColumns({
        "purpose": cited_block(col("a.purpose"), col("valid")), "scope": cited_block(col("a.scope"), col("valid"), True), "key_obligations": first(F.filter(blocks, lambda x: x.isNotNull()), OBLIGATIONS),
        "structure": said(col("a.structure"), STRUCTURE), "related_instruments": known_instruments(col("a.relatedInstruments"), candidates),
    })
    error = (F.when(col("json").isNull(), "no JSON object").when(col("purpose").isNull(), "no purpose").when(col("scope").isNull(), "no cited scope")
             .when(F.size("key_obligations") == 0, "no cited key obligations").when(col("structure") == "", "no structure"))
    names = ["purpose", "scope", "key_obligations", "structure", "related_instruments"]
    return parts.withColumn("error", error).select("law", *(F.when(col("error").isNull(), col(n)).alias(n) for n in names), "error")


def grounded_digests(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """law, article, summary, themes (name, description, cites) and no_case_law of ``answers`` (law, article, answer).

    cases: law, article, ordinal, celex, ecli, case_number, name, declarations (numbers). A cite is kept if its case is there,
    by ECLI or else by CELEX, each once; a declaration that the case doesn't have is null. Themes without a cite go; without a
    summary or theme, or without cases, there is no case law. An answer that holds no JSON has a null no_case_law.
    """
    case = F.struct("ordinal", "celex", "ecli", "case_number", "name", "declarations")
    gathered = cases.groupBy("law", "article").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    parsed = answers.join(gathered, ["law", "article"], "left").withColumn("json", json_object(col("answer"))).withColumn("a", F.from_json("json", "summary string, noCaseLaw string, themes array<string>"))

    def cited(own: Column) -> Column:
        number = said(F.coalesce(*(F.nullif(own[n], F.lit("")) for n in ("declarationNumber", "declaration", "paragraph"))), 20)
        return F.struct(F.nullif(said(own["ecli"], 80), F.lit("")).alias("ecli"), F.nullif(said(own["celex"], 40), F.lit("")).alias("celex"), number.alias("number"))

    def known(x: Column) -> Column:
        last = lambda test: F.try_element_at(F.filter("cases", test), F.lit(-1))
        declared = lambda found: F.when(F.array_contains(found["declarations"], x["number"]), x["number"])
        kept = lambda found: F.struct(*(found[n].alias(n) for n in ("ecli", "celex", "case_number", "name")), declared(found).alias("declaration"))
        return bound(F.coalesce(last(lambda c: c["ecli"] == x["ecli"]), last(lambda c: c["celex"] == x["celex"])), lambda found: F.when(found.isNotNull(), kept(found)))

    def cite(x: Column) -> Column:
        return bound(bound(F.from_json(x, "ecli string, celex string, declarationNumber string, declaration string, paragraph string"), cited), known)

    def theme_of(own: Column) -> Column:
        cites = F.array_distinct(F.filter(F.transform(F.coalesce(own["cites"], F.array().cast("array<string>")), cite), lambda c: c.isNotNull()))
        return F.struct(said(own["name"], NAME).alias("name"), said(own["description"], TEXT).alias("description"), first(cites, CITES).alias("cites"))

    def theme(x: Column) -> Column:
        kept = lambda t: F.when((t["name"] != "") & (t["description"] != "") & (F.size(t["cites"]) > 0), t)
        return bound(bound(F.from_json(x, "name string, description string, cites array<string>"), theme_of), kept)

    themes = first(F.filter(F.transform(F.coalesce("a.themes", F.array().cast("array<string>")), theme), lambda t: t.isNotNull()), THEMES)
    read = parsed.withColumns({"themes": themes, "summary": said(col("a.summary"), SUMMARY)})
    none = (F.coalesce(col("a.noCaseLaw"), F.lit("")) == "true") | col("cases").isNull() | (col("summary") == "") | (F.size("themes") == 0)
    no_case_law = F.when(col("json").isNotNull(), none)
    kept = ~F.coalesce(no_case_law, F.lit(True))
    return read.select("law", "article", F.when(kept, col("summary")).otherwise("").alias("summary"), F.when(kept, col("themes")).otherwise(F.slice("themes", 1, 0)).alias("themes"), no_case_law.alias("no_case_law"))


def bundles(chosen: DataFrame, articles: DataFrame, definitions: DataFrame, links: DataFrame, recitals: DataFrame, cases: DataFrame, most: int = 6) -> DataFrame:
    """One nested row per law that has one of the chosen articles: articles, definitions, recitals and cases.

    chosen: law, number; articles: law, ordinal, number, title, text; definitions: law, ordinal, term, definition; links: law,
    number, recital, score; recitals: law, recital, text; cases: law, number, celex, date, name, paragraph, point. Articles
    are in the law's order; definitions those whose term stands in a chosen article; recitals those of the ``most`` best per
    article, by their best score, then number; cases by date, latest first, each with its references. All four are grouped
    by law, none larger than one law's own.
    """
    wanted = chosen.where("number is not null").distinct()
    own = articles.join(wanted, ["law", "number"], "left_semi")
    texts = own.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ordinal", "number", "title", "text"))).alias("articles"))
    found = definitions.join(own.select("law", F.lower("text").alias("body")), "law").where((col("term") != "") & col("body").contains(F.lower("term"))).select("law", "ordinal", "term", "definition").distinct()
    terms = found.groupBy("law").agg(F.array_sort(F.collect_list(F.struct("ordinal", "term", "definition"))).alias("definitions"))
    place = F.row_number().over(Window.partitionBy("law", "number").orderBy(F.desc("score"), "recital"))
    best = links.join(wanted, ["law", "number"], "left_semi").withColumn("place", place).where(col("place") <= most).groupBy("law", "recital").agg(F.max("score").alias("score"))
    scored = best.join(recitals.select("law", "recital", "text"), ["law", "recital"], "left")
    reasons = scored.groupBy("law").agg(F.array_sort(F.collect_list(F.struct((-col("score")).alias("o"), "recital", "text", "score"))).alias("recitals"))
    referring = cases.join(wanted, ["law", "number"], "left_semi").groupBy("law", "celex").agg(F.max(F.coalesce("date", F.lit(""))).alias("date"), F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("number", "paragraph", "point"))).alias("refs"))
    latest = F.array_sort(F.collect_list(F.struct("date", "celex", "name", "refs")), lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).when(a["celex"] < b["celex"], -1).when(a["celex"] > b["celex"], 1).otherwise(0))
    judged = referring.groupBy("law").agg(latest.alias("cases"))
    joined = texts.join(terms, "law", "left").join(reasons, "law", "left").join(judged, "law", "left")
    return joined.select("law", "articles", "definitions", F.transform("recitals", lambda r: F.struct(r["recital"].alias("recital"), r["text"].alias("text"), r["score"].alias("score"))).alias("recitals"), "cases")
