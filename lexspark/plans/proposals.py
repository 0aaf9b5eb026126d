"""Registered queries on proposals, each beside its DuckDB equivalent; a customer's orders are the lines of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.sources import html_laws, markup, proposals
from lexspark.sources.adapters import spread, table

KIND = "case when o_orderkey % 13 < 3 then 'heading' when o_orderkey % 13 < 5 then 'article' when o_orderkey % 13 < 7 then 'annex' when o_orderkey % 13 = 7 then 'enacting' end"
LINE = """case o_orderkey % 13 when 0 then 'CHAPTER ' || (o_orderkey % 9) when 1 then 'Name ' || o_orderkey when 2 then 'Section 1 Own' when 3 then 'Article ' || (o_orderkey % 50) || 'b Some Title'
 when 4 then 'Sole article' when 5 then 'ANNEX IV to it' when 6 then 'Other ' || o_orderkey when 7 then 'HAVE ADOPTED' else 'Text ' || o_orderkey end"""
PAGE = """'<p class="Statut">Draft</p><P class="x Titreobjet">on <b>' || p_name || '</b></P><p class="li ManualConsidrant"><span class="num">(' || (p_partkey % 7 + 2) || ')</span> Later&nbsp; reason</p>'
 || '<p class="li ManualConsidrant"><span class="num">(1)</span>First</p><p class="SectionTitle">TITLE IX</p><p class="Formuledadoption">HAS ADOPTED</p><p class="SectionTitle">TITLE I</p><p class="SectionTitle">Rules</p>'
 || '<p class="Titrearticle">Article ' || p_partkey || '<br/> ' || p_brand || '</p><p>One &amp; two</p><p> </p><p class="li">Three</p><p class="Annexetitre">ANNEX II</p><p>' || p_name || '</p>'"""
MARKUP = """case p_partkey % 6 when 0 then '<div id="a" class="b eli-subdivision">x</div>' when 1 then '<p class="ti-art">Article 1</p><P class="normal">x</P>' when 2 then '<p class="ti-art">x</p>'
 when 3 then '<p class=''a Titrearticle''>x</p>' when 4 then '<p class="ManualConsidrant li">x</p>' else '<p class="titrearticle">x</p>' end"""


def lines(spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.expr(KIND).alias("kind"), F.expr(LINE).alias("text"))


def of(spark, sf: str, html: str) -> DataFrame:
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(html).alias("html"))


def pages(spark, sf: str) -> DataFrame:
    return of(spark, sf, PAGE)


QUERIES = {
    "html_layout": lambda spark, sf: html_laws.layout_names(markup.blocks(of(spark, sf, MARKUP))).withColumnRenamed("doc_id", "p_partkey"),
    "parse_proposal": lambda spark, sf: proposals.parsed(pages(spark, sf)),
    "proposal_titles": lambda spark, sf: proposals.titles(proposals.paragraphs(pages(spark, sf))),
    "proposal_units": lambda spark, sf: proposals.units(lines(spark, sf)),
}

SQL = {
    "html_layout": "select p_partkey, ['structured', 'legacy', 'flat', 'proposal', 'proposal', 'flat'][p_partkey % 6 + 1] as layout from part",
    "parse_proposal": """select p_partkey as doc_id, 'recital' as kind, 1::bigint as ordinal, '1' as number, null as title, null as chapter, null as section, 'First' as text from part
 union all select p_partkey, 'recital', 2, (p_partkey % 7 + 2)::varchar, null, null, null, 'Later reason' from part
 union all select p_partkey, 'article', 1, p_partkey::varchar, p_brand, 'TITLE I — Rules', null, 'One & two' || chr(10) || 'Three' from part
 union all select p_partkey, 'annex', 1, 'II', 'ANNEX II', null, null, p_name from part""",
    "proposal_titles": "select p_partkey as doc_id, 'Draft on ' || p_name as title from part",
    # The kind of a line is known from its key here: 0 chapter, 1 other heading, 2 section, 3 and 4 articles, 5 and 6 annexes, 7 formula.
    "proposal_units": f"""with l as (select o_custkey as doc_id, o_orderkey as pos, o_orderkey % 13 as k, {LINE} as text from orders),
 e as (select *, bool_or(k between 3 and 7) over (partition by doc_id order by pos) as enacting from l),
 s as (select *, count(*) filter (enacting and k in (0, 2) or k between 3 and 6) over w as part, count(*) filter (k between 3 and 6) over w as unit,
 max(case when enacting and k = 0 then pos end) over w as chapter_at, max(case when enacting and k = 2 then pos end) over w as section_at from e window w as (partition by doc_id order by pos)),
 n as (select doc_id, part, min(pos) filter (k = 1 and enacting) as named from s group by 1, 2),
 h as (select *, row_number() over (partition by doc_id, k < 5 order by pos) as ordinal from s where k between 3 and 6),
 b as (select h.doc_id, h.unit, string_agg(t.text, chr(10) order by t.pos) as text from h join s t on t.doc_id = h.doc_id and t.unit = h.unit and t.k > 7 and (h.k > 4 or t.part = h.part) group by 1, 2)
 select h.doc_id, case when h.k < 5 then 'article' else 'annex' end as kind, h.ordinal, case h.k when 3 then regexp_extract(h.text, '[0-9]+b') when 4 then h.ordinal::varchar when 5 then 'IV' else h.text end as number,
 case h.k when 3 then 'Some Title' when 4 then '' else h.text end as title, case when h.k < 5 then c.text || coalesce(' — Name ' || n.named, '') end as chapter,
 case when h.k < 5 and h.section_at > coalesce(h.chapter_at, -1) then 'SECTION 1 — Own' end as section, coalesce(b.text, '') as text
 from h left join b using (doc_id, unit) left join s c on c.doc_id = h.doc_id and c.pos = h.chapter_at left join n on n.doc_id = c.doc_id and n.part = c.part""",
}
