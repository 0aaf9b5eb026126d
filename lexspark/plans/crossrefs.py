"""Registered queries on cross-references, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import crossrefs
from lexspark.sources.adapters import table

# A text per order in one of five languages: an article of an act, a range, a list, a recital, and an act by itself.
LANG = "['EN', 'DE', 'FR', 'ES', 'HU'][o_orderkey % 5 + 1]"
PARTS = """o_orderkey % 200 + 1 as a, o_custkey % 9 + 1 as p, o_custkey % 60 + 300 as b, o_orderkey % 70 as w, o_custkey % 9000 + 1 as n, 1990 + o_orderkey % 30 as y, o_orderkey % 5 as k, o_orderkey % 100 as two"""
TEXT = """case k when 0 then 'See Article ' || a || '(' || p || ')(b) of Regulation (EU) ' || y || '/' || n || ', Articles ' || b || ' to ' || (b + w) || ' and Articles 900, 901a and 903; recital ' || p || ' and Decision ' || two || '/' || n || '/EC, Article ' || a || '.'
 when 1 then 'Nach Artikel ' || a || '(' || p || ')  der Richtlinie ' || y || '/' || n || '/EU und Erwägungsgrund ' || p || '; Artikel ' || b || '.' when 2 then 'à l’article ' || a || ' du règlement (UE) No ' || n || '/' || y || ' et considérants (' || p || ')'
 when 3 then 'artículo ' || a || '(' || p || ')(c) del Reglamento ' || y || '/' || n || ', artículo ' || a || '(' || p || ')(c) del reglamento ' || y || '/' || n else a || '. cikk és ' || b || 'b. cikk(' || p || '); Rendelet ' || y || '/' || n end"""


def texts(spark, sf: str):
    parts = PARTS.split(", ")
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", *parts)
    return rows.select("o_orderkey", F.expr(TEXT).alias("text"), F.get(F.array(*map(F.lit, ("EN", "DE", "FR", "ES", "HU"))), F.col("k").cast("int")).alias("lang"))


def refs(spark, sf: str):
    return crossrefs.extracted(texts(spark, sf), ["o_orderkey"]).select("o_orderkey", "ordinal", "kind", "target", "paragraph", "point", "article", "act_type", "year", "number", "suffix")


def spans(spark, sf: str):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey as text", "l_linenumber as ordinal", "l_partkey % 40 as start", "l_partkey % 40 + cast(l_quantity as int) % 12 as end").distinct()
    return crossrefs.longest_spans(rows, "text")


def links(spark, sf: str):
    page = "concat('<p>Article&nbsp;', o_orderkey, '(2) of Directive 95/', o_custkey, '/EC &amp; <a href=\"x\">Article 3</a>, <b>articles ', o_custkey, '</b> and <i class=\"x oj-ref\">Article 4</i>.</p>')"
    return table(spark, sf, "orders").select("o_orderkey", crossrefs.linked(F.expr(page), F.lit("EN")).alias("html"))


QUERIES = {"xref_refs": refs, "longest_spans": spans, "linked_html": links}


def row(ordinal: str, kind: str, target: str, paragraph: str = "null", point: str = "null", article: str = "null", act: str = "null", year: str = "null", number: str = "null", suffix: str = "null") -> str:
    return f"o_orderkey, ({ordinal})::bigint, '{kind}', ({target})::varchar, ({paragraph})::varchar, {point}, ({article})::varchar, {act}, ({year})::varchar, ({number})::varchar, {suffix}"


SPANS = "select distinct l_orderkey as text, l_linenumber as ordinal, l_partkey % 40 as start, l_partkey % 40 + l_quantity::int % 12 as \"end\" from lineitem"
_TWO = "case when two >= 50 then 1900 + two else 2000 + two end"
SQL = {
    # The range comes to 1 or to w + 1 articles; the later ones stand behind it.
    "xref_refs": f"""with t as (select o_orderkey, {PARTS} from orders), m as (select *, case when w <= 50 then w + 1 else 1 end as many, case when two < 10 then two::varchar else two::varchar end as short from t),
 r(o_orderkey, ordinal, kind, target, paragraph, point, article, act_type, year, number, suffix) as (
 select {row("i", "article", "b + i - 1")} from m, generate_series(1, 51) s(i) where k = 0 and i <= many
 union all select {row("many + j", "article", "['900', '901a', '903'][j]")} from m, (values (1), (2), (3)) v(j) where k = 0 union all select {row("many + 4", "article", "a")} from m where k = 0
 union all select {row("many + 5", "recital", "p")} from m where k = 0
 union all select {row("many + 6", "external", "two || '/' || n || '/EC'", act="'decision'", year=f"case when n between 1000 and 9999 then n else {_TWO} end", number="case when n between 1000 and 9999 then two else n end", suffix="'EC'")} from m where k = 0 and two >= 10
 union all select {row("many + 6 + (two >= 10)::int", "external", "y || '/' || n", "p", "'b'", "a", "'regulation'", "y", "n")} from m where k = 0
 union all select {row("1", "article", "b")} from m where k = 1 union all select {row("2", "recital", "p")} from m where k = 1
 union all select {row("3", "external", "y || '/' || n || '/EU'", "p", article="a", act="'directive'", year="y", number="n", suffix="'EU'")} from m where k = 1
 union all select {row("case when n >= 10 then 1 else 2 end", "recital", "p")} from m where k = 2 and n >= 10 union all select {row("1", "article", "a")} from m where k = 2 and n < 10 union all select {row("2", "recital", "p")} from m where k = 2 and n < 10
 union all select {row("2", "external", "n || '/' || y", article="a", act="'regulation'", year="case when n > 999 then n else y end", number="case when n > 999 then y else n end")} from m where k = 2 and n >= 10
 union all select {row("1", "external", "y || '/' || n", "p", "'c'", "a", "'regulation'", "y", "n")} from m where k = 3
 union all select {row("1", "article", "a")} from m where k = 4 union all select {row("2", "article", "b || 'b'", "p")} from m where k = 4 union all select {row("3", "external", "y || '/' || n", act="'regulation'", year="y", number="n")} from m where k = 4)
 select * from r""",
    "longest_spans": f"""with recursive s as ({SPANS}), picked as (select * from (select *, row_number() over (partition by text order by start, "end" desc, ordinal) as place from s) where place = 1
 union all select text, ordinal, start, "end", 1 from (select s.*, row_number() over (partition by s.text order by s.start, s."end" desc, s.ordinal) as next from picked p join s on s.text = p.text and (s.start, -s."end", s.ordinal) > (p.start, -p."end", p.ordinal) and s.start >= p."end") where next = 1)
 select text, ordinal, start, "end" from picked""",
    "linked_html": """select o_orderkey, '<p><a class="external-ref" href="https://eur-lex.europa.eu/search.html?scope=EURLEX&amp;text=Article%C2%A0' || o_orderkey || '%282%29+of+Directive+95%2F' || o_custkey || '%2FEC&amp;lang=en&amp;type=quick" target="_blank" rel="noopener noreferrer" title="Open 95/' || o_custkey
 || '/EC on EUR-Lex" data-ref-raw="Article' || chr(160) || o_orderkey || '(2) of Directive 95/' || o_custkey || '/EC" data-ref-article="' || o_orderkey || '" data-ref-paragraph="2" data-ref-act-type="directive" data-ref-year="'
 || case when o_custkey between 1000 and 9999 then o_custkey else 1995 end || '" data-ref-number="' || case when o_custkey between 1000 and 9999 then 95 else o_custkey end || '" data-ref-suffix="EC">Article&nbsp;' || o_orderkey || '(2) of Directive 95/' || o_custkey
 || '/EC</a> &amp; <a href="x">Article 3</a>, <b><a class="cross-ref" data-ref-article="' || o_custkey || '" href="#article-' || o_custkey || '" title="Go to Article ' || o_custkey || '">articles ' || o_custkey || '</a></b> and <i class="x oj-ref">Article 4</i>.</p>' as html from orders""",
}
