"""Registered queries on laws without structural markup, each beside its DuckDB equivalent; a customer's orders are the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.sources import flat_laws
from lexspark.sources.adapters import spread, table

LINE = """case o_orderkey % 11 when 0 then 'CHAPTER ' || (o_orderkey % 9) when 1 then 'GENERAL RULES ' || o_custkey when 2 then 'Article ' || (o_orderkey % 100) || 'a' when 3 then 'Definitions'
 when 4 then '(b) “Word ' || o_orderkey || '” means a thing;' when 5 then 'Some text.' when 6 then 'Section 2 Rest' when 7 then 'Article ' || o_orderkey when 8 then 'Name without a stop' when 9 then '(' || (o_orderkey % 50) || ') Reason ' || o_orderkey else 'Whereas:' end"""
PAGE = "case p_partkey % 3 when 0 then '<p>No</p><TXT_TE><p class=\"a\">' || p_name || '</p>\n<P> &amp;&nbsp; b <i>' || p_brand || '</i></P></TXT_TE>' when 1 then '<TXT_TE/><p>' || p_name || '<p> </p><pre>x</pre>' else 'none' end"


def lines(spark, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.expr(LINE).alias("text"))


def pages(spark, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(PAGE).alias("html"))


def articles(spark, sf: str) -> DataFrame:
    return flat_laws.articles(lines(spark, sf)).withColumn("body", F.array_join("body", "\n"))


QUERIES = {
    "flat_paragraphs": lambda spark, sf: flat_laws.paragraphs(pages(spark, sf)),
    "parse_flat_law": articles,
    "flat_definitions": lambda spark, sf: flat_laws.definitions(flat_laws.articles(lines(spark, sf))),
    "flat_recitals": lambda spark, sf: flat_laws.recitals(lines(spark, sf)),
}

# The kind of a line is known from its key here: 0 chapter, 1 capitals, 2 and 7 articles, 3, 8 and 10 may be titles, 6 section.
PARTS = f"""l as (select o_custkey as doc_id, o_orderkey as pos, o_orderkey % 11 as k, {LINE} as text from orders),
 g as (select *, count(*) filter (k in (2, 7)) over (partition by doc_id order by pos) as ordinal from l),
 n as (select *, lag(k) over w as before, case when lead(k) over w = 1 then ' — ' || lead(text) over w else '' end as following from g where ordinal > 0 window w as (partition by doc_id order by pos)),
 d as (select *, max(case when k = 0 then pos end) over w as chapter_at, max(case when k = 6 then pos end) over w as section_at from n window w as (partition by doc_id order by pos)),
 b as (select *, k in (3, 8, 10) and row_number() over (partition by doc_id, ordinal, k in (3, 8, 10) order by pos) = 1 as is_title from d where k not in (0, 6) and not (k = 1 and coalesce(before, -1) = 0)),
 a as (select doc_id, ordinal, any_value(regexp_extract(text, '[0-9]+a?$')) filter (k in (2, 7)) as number, any_value(text) filter (is_title) as title, any_value(chapter_at) filter (k in (2, 7)) as chapter_at,
 bool_or(k in (2, 7) and section_at > coalesce(chapter_at, -1)) as in_section, list(text order by pos) filter (k not in (2, 7) and not is_title) as body from b group by 1, 2)"""
SQL = {
    "flat_paragraphs": "select p_partkey as doc_id, i::bigint as pos, case i when 1 then p_name else '& b ' || p_brand end as text from part, (values (1), (2)) v(i) where i <= case p_partkey % 3 when 0 then 2 when 1 then 1 else 0 end",
    "parse_flat_law": f"""with {PARTS} select a.doc_id, a.ordinal, number, title, c.text || c.following as chapter, case when in_section then 'SECTION 2 — Rest' end as section, coalesce(array_to_string(body, chr(10)), '') as body
 from a left join n c on c.doc_id = a.doc_id and c.pos = a.chapter_at""",
    "flat_definitions": f"""with {PARTS}, e as (select doc_id, ordinal, unnest(body) as line, generate_subscripts(body, 1) as place from a where title = 'Definitions')
 select doc_id, ordinal, place, 'Word ' || regexp_extract(line, '[0-9]+') as term, 'a thing' as definition from e where line like '(b)%'""",
    "flat_recitals": f"""with {PARTS}, r as (select *, count(*) filter (k = 9) over (partition by doc_id order by pos) - count(*) filter (k = 9 and pos < o) over (partition by doc_id order by pos) as recital
 from (select *, min(case when k = 10 then pos end) over (partition by doc_id) as o, max(ordinal) over (partition by doc_id) as last from g) where ordinal = 0 and last > 0 and o is not null)
 select doc_id, recital as ordinal, (min(pos) % 50)::varchar as number, string_agg(regexp_replace(text, '^\\([0-9]+\\) ', ''), ' ' order by pos) as text from r where pos > o and recital > 0 group by 1, 2""",
}
