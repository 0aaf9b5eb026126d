"""Registered queries on judgments, each beside its DuckDB equivalent; pages in four layouts are made from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.sources import judgments
from lexspark.sources.adapters import spread, table

GROUNDS = "On those grounds, the Court (Grand&nbsp;Chamber) hereby rules:"
TABLES = (
    f"""'<p class="coj-normal">Costs</p><table><tr><td><p class="coj-normal">{GROUNDS}</p></td></tr></table><table><tr><td><p class="coj-count coj-bold">1.</p></td><td><p class="coj-normal">' || p_name"""
    """ || '</p></td></tr></table><table><tr><td><p class="coj-count"><span class="coj-bold">2.</span></p></td><td><p class="coj-normal">' || p_type"""
    """ || '</p></td></tr></table><table><tr><td><p class="coj-normal">&amp; ' || p_brand || '</p></td></tr></table><p class="coj-signaturecase">X</p><table><tr><td class="coj-count coj-bold">3.</td></tr></table>'"""
)
CLASSES = f"""'<P class="C41DispositifIntroduction">{GROUNDS}</P><P class="C08Dispositif">1.&nbsp;' || p_name || '</P><P class="C09DispositifAlt">' || p_type || ' &amp; ' || p_brand || '</P>'"""
TERMS = f"""'<dt>7.</dt><p>{GROUNDS}</p><b><dt>1.</dt><dd></dd> ' || p_name || '<dt> 2. </dt><dd>' || p_type || ' &amp;&nbsp;' || p_brand || '</dd></b><table><tr><td>X</td></tr></table>'"""
TEXT = """'<div>On those grounds, THE COURT (First Chamber) rules: ' || case when p_partkey % 2 = 0 then '1. ' || p_name || ' 2. ' else '' end || p_type || ' &amp; ' || p_brand || '. Delivered in open court</div>'"""
HTML = f"case p_partkey % 5 when 0 then {TABLES} when 1 then {CLASSES} when 2 then {TERMS} when 3 then {TEXT} else '<p>' || p_name || '</p>' end"
HEAD = """'<p class="coj-sum-title-1">JUDGMENT OF THE COURT (' || case p_partkey % 3 when 0 then 'Grand&nbsp;Chamber' when 1 then 'full Court' else 'x' end || ')</p><p class="coj-sum-title-1">' || (1 + p_partkey % 28) || ' May  2004</p><p class="coj-index">( ' || p_name || ' )</p><p>In Case C‑' || p_partkey || '/04,</p>'
 || case p_partkey % 4 when 0 then '<span class="coj-bold">' || p_brand || ',</span> v <span class="coj-bold">' || p_type || '</span>' when 1 then '<p class="C02AlineaAltA"><b>' || p_brand || '</b></p><p class="C02AlineaAltA"><B>' || p_type || ';</B></p>'
 when 2 then '<font class="oj-font1"><b>Case C-1/04</b></font><font class="oj-font1"><b>' || p_brand || '<br/>Co</b></font>' else '' end || case when p_partkey % 2 = 0 then ' ECLI:EU:C:2004:' || p_partkey else '' end"""


def of(spark, sf: str, html: str):
    return spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(html).alias("html"))


QUERIES = {
    "judgment_declarations": lambda spark, sf: judgments.declarations(of(spark, sf, HTML)),
    "judgment_metadata": lambda spark, sf: judgments.metadata(of(spark, sf, HEAD)),
}
SQL = {
    "judgment_declarations": """select p_partkey as doc_id, i::bigint as ordinal, i::bigint as number, case when i = 1 and not (p_partkey % 5 = 3 and p_partkey % 2 = 1) then p_name
 else p_type || ' & ' || p_brand || case when p_partkey % 5 = 3 then '.' else '' end end as text
 from part, (values (1), (2)) v(i) where p_partkey % 5 < 4 and (i = 1 or p_partkey % 5 < 3 or p_partkey % 2 = 0)""",
    "judgment_metadata": """select p_partkey as doc_id, case p_partkey % 3 when 0 then 'Grand Chamber' when 1 then 'full Court' end as formation, (1 + p_partkey % 28) || ' May 2004' as date, '( ' || p_name || ' )' as subject,
 'C-' || p_partkey || '/04' as case_number, case when p_partkey % 2 = 0 then 'ECLI:EU:C:2004:' || p_partkey end as ecli, case when p_partkey % 4 < 2 then p_brand || ' v ' || p_type when p_partkey % 4 = 2 then p_brand || ' Co' end as parties from part""",
}
