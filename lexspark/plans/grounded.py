"""Registered queries on models' answers and bundles, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import grounded, tfidf
from lexspark.plans.oracle import RECITALS, UNITS
from lexspark.sources import adapters
from lexspark.sources.adapters import spread, table

# Each part is a law with p_size % 5 + 1 articles and two instruments; its answer cites articles that exist and others.
ANSWER = """case when p_partkey % 11 = 0 then 'I cannot say.' when p_partkey % 11 = 1 then '{"purpose": "only this"}' else '```json' || chr(10) || '{"purpose": ' || case when p_partkey % 3 = 0 then '"To rule <b>' || p_name || '</b>"' else '{"text": "To rule ' || p_name || '", "citations": ["Art. 1", "7", 1, "1"]}' end
 || ', "scope": {"text": "' || p_type || '", "citations": ["2", "art 3", "1"]}, "keyObligations": [{"text": "First", "citations": ["' || (p_partkey % 7) || '"]}, {"text": "", "citations": ["1"]}, {"text": "' || repeat('long ', p_size * 5) || '", "citations": ["1", "x"]}, "bare"], "structure": "'
 || p_brand || ' &amp; rest", "relatedInstruments": [{"label": "Act ' || p_partkey || '", "relationship": "amends"}, {"label": "Other", "celex": "3' || p_partkey || '", "relationship": "repeals"}, {"label": "Invented", "celex": "9", "relationship": "none"}, {"label": "act ' || p_partkey || '"}, 5]}' || chr(10) || '```' end"""


def summaries(spark, sf: str):
    part = table(spark, sf, "part")
    answers = spread(part).select(F.col("p_partkey").alias("law"), F.expr(ANSWER).alias("answer"))
    articles = part.select(F.col("p_partkey").alias("law"), F.explode(F.expr("transform(sequence(1, p_size % 5 + 1), x -> cast(x as string))")).alias("number"))
    listed = part.selectExpr("p_partkey as law", "stack(2, 1L, 'Act ' || p_partkey, cast(null as string), 2L, 'Main act', '3' || p_partkey) as (ordinal, label, celex)")
    found = grounded.grounded_summaries(answers, articles, listed)
    block = lambda c: F.concat_ws("|", f"{c}.text", F.array_join(f"{c}.citations", " "))
    obligations = F.array_join(F.transform("key_obligations", lambda o: F.concat_ws("|", o["text"], F.array_join(o["citations"], " "))), ";")
    related = F.array_join(F.transform("related_instruments", lambda r: F.concat_ws("|", r["label"], r["celex"], r["relationship"])), ";")
    told = F.col("error").isNull()
    return found.select("law", F.when(told, block("purpose")).alias("purpose"), F.when(told, block("scope")).alias("scope"), obligations.alias("obligations"), "structure", related.alias("related"), "error")


# Each order is an article of a law; its cases are its line items, a third of which have no ECLI.
DIGEST = """case o_orderkey % 5 when 0 then '{"noCaseLaw": true, "summary": "x"}' when 1 then 'none' else '{"summary": "On ' || o_orderkey || '", "themes": [{"name": "All", "description": "d", "cites": [{"ecli": "E' || o_orderkey || '-1", "declarationNumber": 1}, {"celex": "C' || o_orderkey || '-2", "declaration": "9"},
 {"ecli": "E' || o_orderkey || '-1", "paragraph": "1"}, {"ecli": "none", "celex": "C' || o_orderkey || '-3"}, 7]}, {"name": "Ungrounded", "description": "d", "cites": [{"ecli": "E0"}]}, {"name": "", "description": "d", "cites": [{"ecli": "E' || o_orderkey || '-1"}]}]}' end"""


def digests(spark, sf: str):
    cases = table(spark, sf, "lineitem").selectExpr("l_orderkey as law", "'1' as article", "l_linenumber as ordinal", "concat('C', l_orderkey, '-', l_linenumber) as celex", "case when l_linenumber % 3 <> 0 then concat('E', l_orderkey, '-', l_linenumber) end as ecli", "concat('case ', l_partkey) as case_number", "l_returnflag as name", "array('1', '2') as declarations")
    answers = table(spark, sf, "orders").select(F.col("o_orderkey").alias("law"), F.lit("1").alias("article"), F.expr(DIGEST).alias("answer"))
    found = grounded.grounded_digests(answers, cases)
    written = F.transform("themes", lambda t: F.concat_ws(":", t["name"], F.array_join(F.transform(t["cites"], lambda c: F.concat_ws("/", F.coalesce(c["ecli"], F.lit("-")), c["celex"], c["case_number"], c["name"], F.coalesce(c["declaration"], F.lit("-")))), " ")))
    return found.select("law", "summary", F.array_join(written, ";").alias("themes"), "no_case_law")


def nested_bundles(spark, sf: str):
    units = adapters.units(spark, sf)
    number = F.col("ord").cast("string")
    articles = units.where("kind = 'article'").select(F.col("doc_id").alias("law"), F.col("ord").alias("ordinal"), number.alias("number"), F.lit(None).cast("string").alias("title"), "text")
    recitals = units.where("kind = 'recital'").select(F.col("doc_id").alias("law"), F.col("ord").alias("recital"), "text")
    terms = units.where("kind = 'recital'").select(F.col("doc_id").alias("law"), F.col("ord").alias("ordinal"), F.regexp_extract(F.lower("text"), "([a-z]+ [a-z]{3,})", 1).alias("term"), F.concat(F.lit("meaning "), number).alias("definition"))
    links = tfidf.recital_links(units).select(F.col("doc_id").alias("law"), F.col("article").cast("string").alias("number"), "recital", "score")
    edges = adapters.edges(spark, sf)
    cases = edges.selectExpr("act as law", "cast(ord as string) as number", "concat('6', law) as celex", "date", "kind as name", "cast(law % 3 as string) as paragraph", "cast(null as string) as point")
    chosen = table(spark, sf, "documents").select(F.col("doc_id").alias("law"), F.explode(F.array(F.lit("1"), F.lit("3"))).alias("number"))
    return grounded.bundles(chosen, articles, terms, links, recitals, cases)


def bundle(spark, sf: str):
    found = nested_bundles(spark, sf)
    join = lambda c, f: F.array_join(F.transform(c, f), ";")
    return found.select(
        "law", join("articles", lambda a: F.concat_ws(":", a["number"], F.length(a["text"]))).alias("articles"), join("definitions", lambda d: F.concat_ws(":", d["term"], d["definition"])).alias("definitions"),
        join("recitals", lambda r: F.concat_ws(":", r["recital"], F.length(r["text"]))).alias("recitals"), join("cases", lambda c: F.concat_ws(":", c["date"], c["celex"], F.array_join(F.transform(c["refs"], lambda r: F.concat_ws("/", r["number"], r["paragraph"])), ","))).alias("cases"),
    )


QUERIES = {"grounded_summaries": summaries, "grounded_digests": digests, "bundle_multi": bundle}

BUNDLED = f"""{RECITALS}, term as (select doc_id, ord, regexp_extract(lower(text), '([a-z]+ [a-z]{{3,}})', 1) as term from units where kind = 'recital'),
 used as (select * from term where term <> '' and exists (select 1 from units u where u.doc_id = term.doc_id and u.kind = 'article' and u.ord in (1, 3) and contains(lower(u.text), term))),
 b as (select doc_id, recital, max(score) as score from (select *, row_number() over (partition by doc_id, article order by score desc, recital) as p from links where article in (1, 3)) where p <= 6 group by 1, 2),
 e as (select l_partkey as doc_id, l_orderkey, max(strftime(l_shipdate, '%Y-%m-%d')) as date, min(case l_returnflag when 'A' then 'amends' when 'N' then 'implements' else 'interprets' end) as name,
  string_agg(l_linenumber || '/' || (l_orderkey % 3), ',' order by l_linenumber) as refs, string_agg('Art. ' || l_linenumber || '(' || (l_orderkey % 3) || ')', ', ' order by l_linenumber) as cited from lineitem where l_linenumber in (1, 3) group by 1, 2)"""
_LONG = "case when p_size * 25 - 1 > 900 then rtrim(substring(repeat('long ', p_size * 5), 1, 900)) || '...' else rtrim(repeat('long ', p_size * 5)) end"
SQL = {
    "grounded_summaries": f"""with s as (select *, p_size % 5 + 1 as n, p_partkey % 7 as c, p_partkey % 11 as bad from part),
 t as (select *, case when p_partkey % 3 = 0 then 'To rule ' || p_name || '|' else 'To rule ' || p_name || '|1' end as purpose, p_type || '|' || case when n >= 3 then '2 3 1' when n = 2 then '2 1' else '1' end as scope,
 case when c between 1 and n then 'First|' || c || ';' else '' end || case when p_size > 0 then {_LONG} || '|1' else '' end as obligations from s)
 select p_partkey as law, case when bad > 1 then purpose end as purpose, case when bad > 1 then scope end as scope, case when bad > 1 then obligations end as obligations, case when bad > 1 then p_brand || ' & rest' end as structure,
 case when bad > 1 then 'Act ' || p_partkey || '|amends;Main act|3' || p_partkey || '|repeals' end as related, case bad when 0 then 'no JSON object' when 1 then 'no cited scope' end as error from t""",
    "grounded_digests": """with c as (select l_orderkey as law, max(case when l_linenumber = 1 then 'E' || l_orderkey || '-1/C' || l_orderkey || '-1/case ' || l_partkey || '/' || l_returnflag || '/1' end) as one,
 max(case when l_linenumber = 2 then 'E' || l_orderkey || '-2/C' || l_orderkey || '-2/case ' || l_partkey || '/' || l_returnflag || '/-' end) as two, max(case when l_linenumber = 3 then '-/C' || l_orderkey || '-3/case ' || l_partkey || '/' || l_returnflag || '/-' end) as three from lineitem group by 1),
 d as (select o_orderkey as law, o_orderkey % 5 as k, concat_ws(' ', one, two, three) as cites from orders left join c on law = o_orderkey)
 select law, case when k > 1 and cites <> '' then 'On ' || law else '' end as summary, case when k > 1 and cites <> '' then 'All:' || cites else '' end as themes, case when k <> 1 then k = 0 or cites = '' end as no_case_law from d""",
    "bundle_multi": f"""with {BUNDLED}, a as (select doc_id, string_agg(ord || ':' || length(text), ';' order by ord) as articles from units where kind = 'article' and ord in (1, 3) group by 1),
 d as (select doc_id, string_agg(term || ':meaning ' || ord, ';' order by ord) as definitions from used group by 1),
 r as (select b.doc_id, string_agg(recital || ':' || length(u.text), ';' order by score desc, recital) as recitals from b join units u on u.doc_id = b.doc_id and u.kind = 'recital' and u.ord = recital group by 1),
 c as (select doc_id, string_agg(date || ':6' || l_orderkey || ':' || refs, ';' order by date desc, '6' || l_orderkey) as cases from e group by 1)
 select a.doc_id as law, articles, definitions, recitals, cases from a left join d using (doc_id) left join r using (doc_id) left join c using (doc_id)""",
}
