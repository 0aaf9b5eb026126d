"""Registered queries on what a model is given and on stored files, each beside its DuckDB equivalent."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators import prompts
from lexspark.plans.grounded import BUNDLED, nested_bundles
from lexspark.plans.oracle import EDGES, UNITS
from lexspark.sources import adapters, archives
from lexspark.sources.adapters import table

DIVIDED = """o_custkey as law, o_orderkey as ordinal, cast(o_orderkey % 50 as string) as number, case when o_orderkey % 4 > 0 then 'Title ' || o_orderkey end as title,
 case when o_orderkey % 5 > 0 then 'CHAPTER ' || (o_orderkey % 3) end as chapter, case when o_orderkey % 5 > 0 and o_orderkey % 2 = 0 then 'Name ' || o_orderkey end as chapter_title, case when o_orderkey % 7 = 0 then 'SECTION 1' end as section, cast(null as string) as section_title"""


def skeletons(spark, sf: str):
    orders = table(spark, sf, "orders")
    return prompts.skeletons(spark.sql(f"select {DIVIDED} from {{orders}}", orders=orders), "7")


def inputs(spark, sf: str):
    units = adapters.units(spark, sf)
    number = F.col("ord").cast("string")
    of = lambda kind: units.where(F.col("kind") == kind).select(F.col("doc_id").alias("law"), F.col("ord").alias("ordinal"), number.alias("number"), F.lit(None).cast("string").alias("title"), "text")
    mentions = adapters.edges(spark, sf).select(F.col("act").alias("law"), F.concat(F.lit("Act "), F.expr("law % 30")).alias("label"))
    found = prompts.summary_inputs(of("article"), of("recital").drop("title"), mentions)
    join = lambda c, f: F.array_join(F.transform(c, f), "|")
    return found.select("law", join("articles", lambda a: F.concat_ws(":", a["number"], a["text"])).alias("articles"), join("recitals", lambda r: F.concat_ws(":", r["number"], r["text"])).alias("recitals"), join("candidates", lambda c: F.concat_ws(":", c["label"], c["n"].cast("string"))).alias("candidates"))


def bundle_prompts(spark, sf: str):
    return prompts.bundle_prompts(nested_bundles(spark, sf), F.concat(F.lit("What of "), F.col("law").cast("string"), F.lit("?")))


@F.pandas_udf(T.BinaryType())
def zipped(key: pd.Series, text: pd.Series) -> pd.Series:
    """An archive of two data files, named by the manifest last first; every ninth is cut short."""

    def one(k: int, t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("a.fmx.xml", f'<?xml version="1.0"?>\n<A>{t}</A>')
            archive.writestr("b.fmx.xml", f"<B>{k}</B>")
            archive.writestr("x.doc.fmx.xml", '<DOC><REF FILE="b.fmx.xml"/><REF FILE="gone.fmx.xml"/><REF FILE="a.fmx.xml"/></DOC>')
        return out.getvalue()[: 40 if k % 9 == 0 else None]

    return pd.Series([one(k, t) for k, t in zip(key, text)], dtype=object)


def archived(spark, sf: str):
    part = table(spark, sf, "part").selectExpr("p_partkey as k", "p_name as t")
    file = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    xml = lambda text: F.expr(text).cast("binary")
    first, second = file("1.xml", xml("""concat('<?xml version="1.0"?> <A>', t, '</A>')""")), file("2.xml", xml("concat('<B>', k, '</B>')"))
    files = F.when(F.col("k") % 3 == 0, F.array(file("law.zip", zipped("k", "t")), first)).when(F.col("k") % 3 == 1, F.array(second, first)).otherwise(F.array(first, file("note.txt", xml("'x'"))))
    return archives.laws(part.select(F.col("k").alias("law"), F.explode(files).alias("f")).select("law", "f.*")).select("law", "xml", F.col("error").isNotNull().alias("failed"))


QUERIES = {"law_skeletons": skeletons, "summary_inputs": inputs, "bundle_prompts": bundle_prompts, "archive_laws": archived}

_CLIP = "case when length({0}) > {1} then rtrim(substring({0}, 1, {1}), ' ') || '...' else {0} end"
_BARE = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g'))"
_JOINED = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<COMBINED.FMX>' || chr(10) || {0} || chr(10) || '</COMBINED.FMX>'"
SQL = {
    "law_skeletons": f"""with a as (select {DIVIDED.replace("as string)", "as varchar)")} from orders), p as (select *, min(ordinal) over c as c_at, min(ordinal) over s as s_at, first_value(chapter_title) over (partition by law, chapter order by ordinal) as c_title
  from a window c as (partition by law, chapter), s as (partition by law, chapter, section)),
 l as (select law, c_at, -1 as s_at, -1 as placed, chapter || coalesce(' — ' || c_title, '') as line from p where ordinal = c_at and chapter is not null union all select law, c_at, s_at, -1, section from p where ordinal = s_at and section is not null
  union all select law, c_at, s_at, ordinal, '    Art. ' || number || coalesce(' — ' || title, '') || case when number = '7' then '   ← focus' else '' end from p)
 select law, string_agg(line, chr(10) order by c_at, s_at, placed) as skeleton from l group by 1""",
    "summary_inputs": f"""with {UNITS}, {EDGES}, t as (select doc_id as law, kind, ord, {_BARE} as text from units), a as (select law, string_agg(ord || ':' || {_CLIP.format('text', 1200)}, '|' order by ord) as articles from t where kind = 'article' and text <> '' group by 1),
 r as (select law, string_agg(ord || ':' || {_CLIP.format('text', 700)}, '|' order by ord) as recitals from t where kind = 'recital' and ord <= 8 and text <> '' group by 1),
 m as (select act as law, 'Act ' || (law % 30) as label, count(*) as n from edges group by 1, 2), c as (select law, string_agg(label || ':' || n, '|' order by place) as candidates from (select *, row_number() over (partition by law order by n desc, label) as place from m) where place <= 12 group by 1)
 select law, articles, recitals, candidates from a left join r using (law) left join c using (law)""",
    "bundle_prompts": f"""with {BUNDLED}, a as (select doc_id, string_agg(ord::varchar, ', ' order by ord) as numbers, string_agg('[ARTICLE ' || ord || ']' || chr(10) || text || chr(10), chr(10) order by ord) as said from units where kind = 'article' and ord in (1, 3) group by 1),
 d as (select doc_id, '[DEFINITIONS USED IN THESE ARTICLES]' || chr(10) || string_agg('"' || term || '": meaning ' || ord, chr(10) order by ord) || chr(10) as said from used group by 1),
 r as (select b.doc_id, '[RELATED RECITALS]' || chr(10) || string_agg('Recital ' || recital || ': ' || u.text, chr(10) order by score desc, recital) || chr(10) as said from b join units u on u.doc_id = b.doc_id and u.kind = 'recital' and u.ord = recital group by 1),
 c as (select doc_id, '[CJEU CASE LAW (cases citing any of the provided articles)]' || chr(10) || string_agg('6' || l_orderkey || ' — ' || name || ' (' || date || ')' || chr(10) || '  Matching refs: ' || cited, chr(10) order by date desc, '6' || l_orderkey) || chr(10) as said from e group by 1)
 select a.doc_id as law, concat_ws(chr(10), '[LAW] ' || a.doc_id, '[ARTICLES PROVIDED] ' || numbers, '', a.said, d.said, r.said, coalesce(c.said, '[CJEU CASE LAW]' || chr(10) || 'No CJEU judgments in the bundle cite the provided articles.' || chr(10)), '[QUESTION]', 'What of ' || a.doc_id || '?') as prompt
 from a left join d using (doc_id) left join r using (doc_id) left join c using (doc_id)""",
    "archive_laws": f"""select p_partkey::varchar as law, case when p_partkey % 3 = 0 then case when p_partkey % 9 > 0 then {_JOINED.format("'<B>' || p_partkey || '</B>' || chr(10) || '<A>' || p_name || '</A>'")} end
 when p_partkey % 3 = 1 then {_JOINED.format("'<A>' || p_name || '</A>' || chr(10) || '<B>' || p_partkey || '</B>'")} else '<?xml version="1.0"?> <A>' || p_name || '</A>' end as xml, p_partkey % 9 = 0 as failed from part""",
}
