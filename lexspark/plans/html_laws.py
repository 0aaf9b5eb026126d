"""The registered query on acts as pages: every document's lines written in one of the four layouts, read back, and compared
with the lines themselves, to which the DuckDB equivalent adds what the layout says.

Structured pages are in the document's own language, the others in English. Every third article begins a chapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.plans.oracle import UNITS
from lexspark.sources import html_laws
from lexspark.sources.adapters import table

# The words of headings per language of a document, in both engines' map literals.
WORDS = {"en": ("Article", "CHAPTER", "ANNEX"), "de": ("Artikel", "KAPITEL", "ANHANG"), "fr": ("Article", "CHAPITRE", "ANNEXE"), "es": ("Artículo", "CAPÍTULO", "ANEXO")}


def word(k: int) -> str:
    return "case lang " + " ".join(f"when '{lang}' then '{w[k]}'" for lang, w in WORDS.items()) + f" else '{WORDS['en'][k]}' end"


RECITAL = """case doc_id % 4
 when 0 then '<div class="eli-subdivision" id="rct_' || ord || '"><table><tr><td>(' || ord || ')</td><td><p>' || t || '</p></td></tr></table></div>'
 when 1 then case when ord % 2 = 0 then '<p class="normal">(' || ord || ') As ' || t || '</p>' else '<p class="note">Whereas <i>' || t || '</i></p>' end
 when 2 then '<p class="li ManualConsidrant"><span class="num">(' || ord || ')</span> ' || t || '</p>' else '<p>(' || ord || ')' || t || '</p>' end"""
CHAPTER = f"""case when ord % 3 <> 1 or doc_id % 4 = 3 and ord = 1 then '' when doc_id % 4 = 0 then '<p class="oj-ti-section-1">' || {word(1)} || ' ' || ord || '</p><p class="x oj-ti-section-2">Part ' || ord || '</p>'
 when doc_id % 4 = 1 then '<p class="normal">CHAPTER ' || ord || '</p><p class="normal">PART ' || ord || '</p>'
 when doc_id % 4 = 2 then '<p class="SectionTitle">CHAPTER ' || ord || '</p><p class="SectionTitle">Part ' || ord || '</p>' else '<p>CHAPTER ' || ord || ' PART ' || ord || '</p>' end"""
ARTICLE = f"""case doc_id % 4
 when 0 then '<div class="eli-subdivision" id="art_' || ord || '"><div class="eli-title"><p class="oj-ti-art">' || {word(0)} || '&nbsp;' || ord || '</p><p class="oj-sti-art">Name ' || ord || '</p></div><div><p>1. ' || t || '</p></div></div>'
 when 1 then '<p class="ti-art">Article ' || ord || '</p><p class="normal">Name ' || ord || '</p><p class="normal">1. ' || t || '</p>'
 when 2 then '<p class="Titrearticle">Article ' || ord || '<br>Name ' || ord || '</p><p class="Normal">1. ' || t || '</p>'
 else '<P>Article ' || ord || '<P>Name ' || ord || '<p class="x">1. ' || t end"""
ANNEX = f"""case doc_id % 4 when 0 then '<div class="eli-subdivision"><p class="oj-ti-annex">' || {word(2)} || ' IV</p><p class="oj-ti-annex-2">Forms</p><p>Its text.</p></div>'
 when 1 then '<p class="doc-ti">ANNEX IV</p><p class="doc-ti">Forms</p><p class="normal">Its text.</p>' when 2 then '<p class="Annexetitre">ANNEX IV — Forms</p><p>Its text.</p>' else '</TXT_TE>' end"""


def pages(spark, sf: str) -> DataFrame:
    """doc_id and html of every document's page."""
    written = F.col("text")
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        written = F.replace(written, F.lit(mark), F.lit(reference))
    # As units has them: the first half of the lines are recitals, the second articles. A text is shuffled whole, not line by line,
    # and split once: its lines are bound to a name.
    recital, article = (re.sub(r"\bord\b", "x.ord", re.sub(r"\bt\b", "x.t", form)) for form in (RECITAL, f"({CHAPTER}) || ({ARTICLE})"))
    line = "struct(i + 1 as pos, if(i < half, 'recital', 'article') as kind, if(i < half, i, i - half) + 1 as ord, t)"
    block = f"struct(x.pos, x.kind, if(x.kind = 'recital', {recital}, {article}) as block)"
    bound = lambda value, name, plan: f"transform(array({value}), {name} -> {plan})[0]"
    made = bound("split(t, '\n')", "lines", bound("size(lines) div 2", "half", f"transform(filter(transform(lines, (t, i) -> {line}), x -> trim(x.t) <> ''), x -> {block})"))
    texts = table(spark, sf, "documents").where("replace(replace(text, '\n', ''), ' ', '') <> ''").select("doc_id", "lang", written.alias("t")).select("doc_id", "lang", F.expr(made).alias("parts"))
    parts = texts.groupBy("doc_id", "lang").agg(F.collect_list("parts").alias("all")).select("doc_id", "lang", F.expr("if(size(all) = 1, all[0], array_sort(flatten(all)))").alias("parts"))
    of = lambda kind: F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] == kind), lambda p: p["block"]), "\n")
    head = F.expr("case doc_id % 4 when 1 then '<p class=\"doc-ti\">TITLE OF IT</p>' when 2 then '<p class=\"Statut\">Draft</p>' when 3 then '<TXT_TE><p>Some act</p><p>Whereas:</p>' else '<p class=\"oj-doc-ti\">Act</p>' end")
    formula = F.expr("case when doc_id % 4 = 2 then '<p class=\"Formuledadoption\">HAVE ADOPTED</p>' else '' end")
    return parts.select("doc_id", F.concat(F.expr("'<!DOCTYPE html><html lang=\"' || lang || '\"><body><!-- page -->'"), head, of("recital"), formula, of("article"), F.expr(ANNEX), F.lit("</body></html>")).alias("html"))


QUERIES = {"parse_html_law": lambda spark, sf: html_laws.parsed(pages(spark, sf))}
SQL = {
    "parse_html_law": f"""with {UNITS}, u as (select doc_id, lang, kind, ord, doc_id % 4 as k, trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')) as t from units where trim(text) <> ''),
 n as (select *, row_number() over (partition by doc_id, kind order by ord) as ordinal, ['structured', 'legacy', 'proposal', 'flat'][k + 1] as layout, max(case when ord % 3 = 1 and kind = 'article' and (k < 3 or ord > 1) then ord end) over (partition by doc_id, kind order by ord) as chapter_at from u),
 g as (select *, max(case when ord % 2 = 0 then ord else 0 end) over (partition by doc_id order by ord) as given from n where kind = 'recital'),
 r as (select *, row_number() over (partition by doc_id, given order by ord) - (given > 0)::int as after from g)
 select doc_id, layout, kind, ordinal, case when k = 1 and ord % 2 = 1 then (given + after)::varchar else ord::varchar end as number, null as title, null as chapter, null as section, case when k = 1 and ord % 2 = 1 then 'Whereas ' when k = 1 then 'As ' else '' end || t as text from r
 union all select doc_id, layout, kind, ordinal, ord::varchar, 'Name ' || ord, case k when 0 then {word(1)} else 'CHAPTER' end || ' ' || chapter_at || ' — ' || case when k in (0, 2) then 'Part ' else 'PART ' end || chapter_at, null, '1. ' || t from n where kind = 'article'
 union all select distinct doc_id, layout, 'annex', 1, 'IV', case k when 0 then {word(2)} else 'ANNEX' end || ' IV — Forms', null, null, 'Its text.' from n where k < 3""",
}
