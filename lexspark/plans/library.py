"""Registered queries on references, titles, addresses, the library and reports, each beside its DuckDB equivalent.

Their inputs are made from the general tables by expressions that both engines read alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import refs, text
from lexspark.operators import citations, library, tfidf, tooltips
from lexspark.plans.oracle import CITES, EDGES, PIECES, RECITALS, REGISTRY, REQUESTS, UNITS
from lexspark.sources import adapters
from lexspark.sources.adapters import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col, lit = F.col, F.lit


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def made(name: str, source: str, key: str, inputs: dict[str, str], outputs: Callable[[], dict], sql: dict[str, str]) -> None:
    """A query of ``outputs`` (made when it is run) over ``inputs`` made from the columns of a table; ``sql`` says the outputs anew."""
    view = f"(select {key}, {', '.join(f'{x} as {n}' for n, x in inputs.items())} from {source})"

    def plan(spark, sf):
        rows = spread(table(spark, sf, source)).select(key, *(F.expr(x).alias(n) for n, x in inputs.items()))
        return rows.select(key, *(c.alias(n) for n, c in outputs().items()))

    query(name, f"select {key}, {', '.join(f'{x} as {n}' for n, x in sql.items())} from {view}")(plan)


P, K = "part", "p_partkey"
made("entities_decode", P, K, {"t": "'&#' || (65 + p_partkey % 26) || ';&#x' || (30 + p_partkey % 10) || ';&ndash;&LT;b&lt;/b&gt;&amp;quot;&Hellip;&foo;' || p_name", "name": "p_name"},
     lambda: {"text": text.decoded(col("t"))}, {"text": "chr((65 + p_partkey % 26)::int) || (p_partkey % 10) || '-&LT;b</b>&quot;...&foo;' || name"})
made("text_collapse", P, K, {"t": "' ' || chr(160) || p_name || chr(160) || chr(9) || p_brand || chr(10)"}, lambda: {"text": text.collapsed(col("t"))}, {"text": "trim(regexp_replace(replace(t, chr(160), ' '), '\\s+', ' ', 'g'))"})
query("html_strip_references", "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '\\s+', ' ', 'g')) as text from pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", text.without_tags_or_references(col("html")).alias("text")))
made("registry_title", P, K, {"t": "case p_partkey % 5 when 0 then 'CORRELATION TABLE' when 1 then '  ' when 2 then 'Official Journal of the European Union' else ' ' || p_name || '  ' end", "name": "p_name"},
     lambda: {"title": text.registry_title(col("t"))}, {"title": "case when p_partkey % 5 > 2 then name end"})
made("recital_title", P, K, {"t": "chr(34) || repeat(p_name || '  ', cast(1 + p_partkey % 9 as int)) || '.;: '"}, lambda: {"title": text.recital_title(col("t"))},
     {"title": "trim(substring(trim(regexp_replace(regexp_replace(regexp_replace(t, '^[\"''“”‘’]+|[\"''“”‘’]+$', '', 'g'), '[.;:,\\s]+$', ''), '\\s+', ' ', 'g')), 1, 90))"})
made("stem_pattern", P, K, {"t": "p_name || case when p_partkey % 3 = 0 then ' (of) a+b' else '' end"}, lambda: {"pattern": text.stem_pattern(col("t"))},
     {"pattern": "array_to_string(list_transform(string_split_regex(t, '\\s+'), lambda w: regexp_replace(substring(w, 1, greatest(3, length(w) - 3)), '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') || '\\S*'), '\\s+')"})
made("display_title", P, K, {"t": "'regulation  (eu) eec ' || p_name || ' Of ' || p_type"}, lambda: {"title": text.display_title(col("t"))},
     {"title": "'Regulation (EU) EEC ' || array_to_string(list_transform(string_split(lower(regexp_extract(t, 'eec (.*) Of ', 1)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"})
made("short_title", P, K, {"t": "'Regulation 2016/' || p_partkey || ' on  x (abc) (Text with EEA relevance) (' || p_name || ') end'", "reference": "'regulation 2016/' || p_partkey", "name": "p_name"},
     lambda: {"short": text.short_title(col("t")), "rest": text.without_reference(col("t"), col("reference"))}, {"short": "case when length(name) between 5 and 120 then name else '' end", "rest": "'on x (abc) (Text with EEA relevance) (' || name || ') end'"})
made("party_name", P, K, {"t": "'<b>' || p_name || ' &amp; Co&nbsp;</b>,;'", "name": "p_name"}, lambda: {"name": text.bold_name(col("t"))}, {"name": "name || ' & Co'"})
made("annex_title", P, K, {"t": "case p_partkey % 3 when 0 then 'ANNEX IV — ' || p_name || '—x' when 1 then ' Annex IV' else p_name end", "annex": "case when p_partkey % 2 = 0 then 'iv' else 'ANNEX IV' end", "name": "p_name"},
     lambda: {"title": text.annex_title(col("t"), col("annex"))}, {"title": "case p_partkey % 3 when 0 then name || ' — x' when 1 then '' else name end"})
made("html_attribute", P, K, {"t": "'<a href=\"u\"' || case p_partkey % 4 when 0 then ' title=\"' || p_name || '\"' when 1 then ' TITLE=''' || p_name || '''' when 2 then ' title=\"\"' else '' end || '>'", "name": "p_name"},
     lambda: {"title": text.attribute(col("t"), "title")}, {"title": "case p_partkey % 4 when 0 then name when 1 then name when 2 then '' end"})
made("line_kinds", P, K, {"t": "case p_partkey % 8 when 0 then 'Article ' || p_partkey || 'a' when 1 then 'ANNEX IV' when 2 then 'Chapter I ' || p_name when 3 then upper(p_name) || ' 4' when 4 then p_name when 5 then '1. ' || p_name when 6 then p_name || '.' else '(iv) ' || p_name end"},
     lambda: {"kind": text.line_kind(col("t"))}, {"kind": "['article', 'annex', 'chapter', 'division_title', 'title', 'text', 'text', 'text'][p_partkey % 8 + 1]"})
made("xml_title_pick", P, K, {"t": "'<TITLE><TI>' || p_name || '</TI></TITLE>' || '<title><TI><P>' || case when p_partkey % 3 = 0 then 'Regulation' else 'Note' end || ' 2016/' || p_partkey || '</P></TI><TI>' || case when p_partkey % 2 = 0 then '(x)' else 'x' end || '</TI></title><TITLE>CORRELATION TABLE</TITLE><TITLE>' || case when p_partkey % 5 = 0 then 'Decision of ' || p_type else '' end || '</TITLE>'"},
     lambda: {"title": text.xml_title(col("t"))},
     {"title": """(select arg_max(title, (score, -i)) from (select i, title, (case when regexp_matches(title, '(?i)\\b(regulation|directive|decision)\\b') then 100 else 0 end) + (case when regexp_matches(title, '\\b\\d{4}/\\d+\\b') then 30 else 0 end)
 + (case when regexp_matches(title, '\\([^)]+\\)') then 15 else 0 end) + least(length(title), 200) / 10 as score from (select i, nullif(nullif(trim(regexp_replace(regexp_replace(replace(b, '</TI><TI>', ' '), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'CORRELATION TABLE') as title
 from (select unnest(l) as b, unnest(generate_series(1, len(l))) as i from (select regexp_extract_all(t, '(?is)<TITLE\\b.*?</TITLE>') as l)))) where title is not null)"""})  # fmt: skip
made("html_title_pick", P, K, {"t": "case when p_partkey % 4 = 0 then '<meta content=\"' || p_name || ' &amp; co\" name=\"WT.z_docTitle\">' when p_partkey % 4 = 1 then '<meta name=\"WT.z_docTitle\" content=\"CORRELATION TABLE\"><p id=\"englishTitle\"> </p><p class=\"x\" id=''title''><b>' || p_name || '</b></p>' when p_partkey % 4 = 2 then '<p id=\"originalTitle\">' || p_type || '</p>' else '<p>none</p>' end", "name": "p_name", "type": "p_type"},
     lambda: {"title": text.html_title(col("t"))}, {"title": "case p_partkey % 4 when 0 then name || ' & co' when 1 then name when 2 then type end"})
made("document_language", P, K, {"t": "case p_partkey % 4 when 0 then '<meta name=\"WT.z_usr_lan\" content=\" fr \">' when 1 then '<p class=\"x oj-hd-lg\"><b>de</b></p>' when 2 then '<meta name=\"WT.z_usr_lan\" content=\"\"><p class=\"oj-hd-lg\">pl</p>' else '<p>de</p>' end"},
     lambda: {"lang": text.document_language(col("t"))}, {"lang": "['FR', 'DE', 'PL', 'EN'][p_partkey % 4 + 1]"})
made("payload_kinds", P, K, {"t": "case p_partkey % 6 when 0 then ' <COMBINED.FMX/>' when 1 then '<p/>' when 2 then '{\"articles\": [' || p_partkey || ']}' when 3 then '{\"payload\": \"<p/>\"}' when 4 then '{broken' else p_name end"},
     lambda: {"kind": text.payload_kind(col("t"))}, {"kind": "['formex', 'xml', 'combined', 'envelope', 'unknown', 'unknown'][p_partkey % 6 + 1]"})
made("json_answer", P, K, {"t": "case p_partkey % 4 when 0 then '```json' || chr(10) || '{\"a\": {\"b\": ' || p_partkey || '}}' || chr(10) || '```' when 1 then 'Here: {\"a\": {\"b\": ' || p_partkey || '}} done' when 2 then '{\"a\": {\"b\": }' else 'none' end"},
     lambda: {"b": F.get_json_object(text.json_object(col("t")), "$.a.b")}, {"b": "case when p_partkey % 4 < 2 then p_partkey::varchar end"})
made("titles_answer", P, K, {"t": "'```{\" 1 \": \"“' || p_name || '.”\", \"2\": \" ,\", \"9\": \"not asked\"}```'", "name": "p_name"},
     lambda: {"titles": F.to_json(text.titles_by_key(col("t"), F.array(lit("1"), lit("2"))))}, {"titles": "'{\"1\":\"' || name || '\"}'"})
made("stream_text", P, K, {"t": "': hello' || chr(10) || 'data: {\"choices\": [{\"delta\": {\"' || case when p_partkey % 3 = 0 then 'reasoning' else 'content' end || '\": \"' || p_name || ' \"}}]}' || chr(13) || chr(10) || chr(10) || 'data: {\"choices\": [{\"delta\": {\"content\": \"' || case when p_partkey % 3 = 0 then '' else 'end' end || '\"}}]}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10)", "name": "p_name"},
     lambda: {"said": text.stream_text(col("t"))}, {"said": "name || ' ' || case when p_partkey % 3 = 0 then '' else 'end' end"})
made("formex_kind", P, K, {"t": "case p_partkey % 3 when 0 then '<COMBINED.FMX>' when 1 then '<ACT xmlns=\"FORMEX\"><ENACTING.TERMS/>' else '<ACT><ENACTING.TERMS/>' end"}, lambda: {"is_formex": text.is_formex(col("t"))}, {"is_formex": "p_partkey % 3 < 2"})

RDF = "case when p_partkey % 3 = 0 then '<x rdf:resource=\"http://h/oj/L_20' || lpad(cast(p_partkey % 10000000 as string), 7, '0') || '.FRA.fmx4\"/>' else '' end || '<x rdf:resource=\"http://h/oj/JOL_2016_' || p_partkey || '_R_1.ENG.fmx4\"/><x rdf:resource=\"http://h/a.fmx4.1.xml\"/><x rdf:resource=\"http://g/b.fmx4.1.xml\"/><x rdf:resource=\"http://h/b.fmx4.2.doc.xml\"/>' || case when p_partkey % 4 = 0 then '<x rdf:resource=\"http://h/all.zip\"/>' else '' end"


def resources(rdf):
    return F.regexp_extract_all(rdf, lit('rdf:resource="([^"]+)"'), lit(1))


def formex_resource(rdf, lang: str):
    """The Formex manifestation in a language, else the English one's address with the language put in its place."""
    of = lambda code: F.get(F.filter(resources(rdf), lambda u: u.rlike(rf"/oj/(JOL_\d{{4}}_\d+_R_\d+|L_\d{{9}})\.{code}\.fmx4$")), lit(0))
    return F.coalesce(of(lang), F.replace(of("ENG"), lit(".ENG.fmx4"), lit(f".{lang}.fmx4")))


def downloads(rdf):
    """What to fetch: the first archive, else the data files, one of each name, else the description."""
    uris = resources(rdf)
    name = lambda u: F.substring_index(u, ".fmx4.", -1)
    data = F.filter(uris, lambda u: u.rlike(r"\.fmx4\.[^/]+\.xml$") & ~u.endswith(".doc.xml"))
    once = F.filter(F.transform(data, lambda u, i: F.struct(u.alias("u"), i.alias("i"))), lambda e: F.array_position(F.transform(data, name), name(e["u"])) == e["i"] + 1)
    zips = F.filter(uris, lambda u: u.endswith(".zip"))
    return F.when(F.size(zips) > 0, F.slice(zips, 1, 1)).when(F.size(once) > 0, F.transform(once, lambda e: e["u"])).otherwise(F.filter(uris, lambda u: u.endswith(".doc.xml")))


made("formex_source", P, K, {"t": RDF}, lambda: {"uri": formex_resource(col("t"), "FRA"), "files": F.array_join(downloads(col("t")), " "), "n_uris": F.size(resources(col("t"))).cast("long")},
     {"uri": "case when p_partkey % 3 = 0 then 'http://h/oj/L_20' || lpad((p_partkey % 10000000)::varchar, 7, '0') || '.FRA.fmx4' else 'http://h/oj/JOL_2016_' || p_partkey || '_R_1.FRA.fmx4' end",
      "files": "case when p_partkey % 4 = 0 then 'http://h/all.zip' else 'http://h/a.fmx4.1.xml' end", "n_uris": "4 + (p_partkey % 3 = 0)::int + (p_partkey % 4 = 0)::int"})

# References and addresses
made("celex_extract", P, K, {"t": "case p_partkey % 4 when 0 then 'see celex%3a32016r' || lpad(cast(p_partkey % 10000 as string), 4, '0') || ' and more' when 1 then 'x CELEX:52021PC' || lpad(cast(p_partkey % 10000 as string), 4, '0') || '(01)' when 2 then 'CELEX 32016R0679' else p_name end"},
     lambda: {"celex": refs.extracted_celex(col("t"))}, {"celex": "case p_partkey % 4 when 0 then '32016R' || lpad((p_partkey % 10000)::varchar, 4, '0') when 1 then '52021PC' || lpad((p_partkey % 10000)::varchar, 4, '0') || '(01)' end"})
made("url_kinds", P, K, {"t": "case p_partkey % 8 when 0 then 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32016R0679' when 1 then 'https://eur-lex.europa.eu/eli/reg/2016/' || (1 + p_partkey % 9999) || '/oj' when 2 then 'https://eur-lex.europa.eu/x?uri=OJ:L_2024_' || (1 + p_partkey % 99999) when 3 then 'https://eur-lex.europa.eu/x?uri=COM:2026:502:FIN' when 4 then 'https://eur-lex.europa.eu/eli/foo/2016/1/oj' when 5 then 'https://example.org/eli/reg/2016/679/oj' when 6 then 'not an address' else 'https://eur-lex.europa.eu/homepage.html' end"},
     lambda: {"kind": refs.url_class(col("t"))}, {"kind": "['celex', 'eli', 'oj', 'com', 'html', null, null, 'html'][p_partkey % 8 + 1]"})
made("comnat_ids", P, K, {"kind": "case when p_partkey % 3 = 0 then 'JOIN' else 'COM' end", "number": "cast(p_partkey * 7 % 30000 as string)", "suffix": "case when p_partkey % 5 = 0 then '' else 'FIN' end"},
     lambda: {"id": refs.comnat_id(col("kind"), lit("2026"), col("number"), col("suffix"))}, {"id": "case when suffix <> '' then 'comnat:' || kind || '_2026_' || case when length(number) < 4 then lpad(number, 4, '0') else number end || '_' || suffix end"})
made("reference_fields", P, K, {"raw": "case when p_partkey % 2 = 0 then '' else '  ' || p_name || ' ' end", "kind": "' Regulation '", "year": "' 2016'", "number": "case when p_partkey % 3 = 0 then '' else ' ' || p_partkey end", "name": "p_name"},
     lambda: {"act_type": F.lower(F.trim("kind")), "normalized": F.coalesce(F.nullif(F.trim("raw"), lit("")), F.concat_ws(" ", F.lower(F.trim("kind")), F.trim("year"), F.nullif(F.trim("number"), lit(""))))},
     {"act_type": "'regulation'", "normalized": "case when p_partkey % 2 = 1 then name when p_partkey % 3 = 0 then 'regulation 2016' else 'regulation 2016 ' || p_partkey end"})
LANG = "case p_partkey % 5 when 0 then 'deu' when 1 then 'SPA' when 2 then '' when 3 then 'xx' else 'FRA' end"
made("law_links", P, K, {"lang": LANG, "number": "cast(p_partkey as string)"},
     lambda: {"act": refs.act_link(lit("32016R0679"), col("lang")), "journal": refs.journal_link(lit("L"), lit("2024"), col("number"), col("lang")), "proposal": refs.proposal_link(lit("COM"), lit("2026"), col("number"), lit("FIN"), col("lang")), "search": refs.search_link(F.concat(lit("regulation 2016/"), col("number")), col("lang"))},
     {"act": "'https://eur-lex.europa.eu/legal-content/' || ['DE', 'SP', 'EN', 'XX', 'FR'][p_partkey % 5 + 1] || '/TXT/?uri=CELEX:32016R0679'", "journal": "'https://eur-lex.europa.eu/legal-content/' || ['DE', 'SP', 'EN', 'XX', 'FR'][p_partkey % 5 + 1] || '/TXT/?uri=OJ:L:2024:' || number || ':TOC'",
      "proposal": "'https://eur-lex.europa.eu/legal-content/' || ['DE', 'SP', 'EN', 'XX', 'FR'][p_partkey % 5 + 1] || '/TXT/?uri=COM:2026:' || number || ':FIN'", "search": "'https://eur-lex.europa.eu/search.html?scope=EURLEX&text=regulation+2016%2F' || number || '&lang=' || ['de', 'sp', 'en', 'xx', 'fr'][p_partkey % 5 + 1] || '&type=quick'"})
made("language_codes", P, K, {"lang": LANG, "two": "case p_partkey % 3 when 0 then 'de' when 1 then 'ES' else 'zz' end"},
     lambda: {"valid": refs.valid_language(col("lang")), "search": refs.search_language(col("lang")), "api": refs.api_language(col("two"))}, {"valid": "['DEU', 'SPA', 'ENG', null, 'FRA'][p_partkey % 5 + 1]", "search": "['de', 'sp', 'en', 'xx', 'fr'][p_partkey % 5 + 1]", "api": "['DEU', 'SPA', 'ENG'][p_partkey % 3 + 1]"})
made("known_celex", P, K, {"t": "case p_partkey % 7 when 0 then 'the gdpr, ' || p_name when 1 then 'Directive 95/46/EC' when 2 then 'xGDPRx' when 3 then 'TFEU and Charter' when 4 then 'Regulation 2016/6790' when 5 then 'of the TEU' else p_name end"},
     lambda: {"celex": refs.known_celex(col("t"))}, {"celex": "['32016R0679', '31995L0046', null, '12012P', '32016R0679', '12012M', null][p_partkey % 7 + 1]"})
made("ip_truncate_all", P, K, {"ip": "case p_partkey % 6 when 0 then '10.1.' || (p_partkey % 256) || '.9' when 1 then '::ffff:10.1.' || (p_partkey % 256) || '.9' when 2 then '2001:db8:' || (p_partkey % 9999) || ':4:5:6:7:8%eth0' when 3 then '2001:db8::' || (p_partkey % 9999) when 4 then 'unknown' else 'host' end"},
     lambda: {"ip": refs.truncated_ip(col("ip"))}, {"ip": "case p_partkey % 6 when 0 then '10.1.' || (p_partkey % 256) || '.0' when 1 then '10.1.' || (p_partkey % 256) || '.0' when 2 then '2001:db8:' || (p_partkey % 9999) || ':4::' when 3 then '2001:db8::::' when 4 then 'unknown' else 'host' end"})
made("url_tail", P, K, {"t": "'http://h/a/b%20' || p_partkey || '%2Fc'"}, lambda: {"tail": F.try_url_decode(F.substring_index("t", "/", -1))}, {"tail": "'b ' || p_partkey || '/c'"})
made("supported_urls", P, K, {"t": "case p_partkey % 4 when 0 then 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32016R0679' when 1 then 'https://eur-lex.europa.eu/eli/dir/2000/31/oj' when 2 then 'https://eur-lex.europa.eu/homepage.html' else 'https://example.org/eli/x' end"},
     lambda: {"supported": F.coalesce(refs.url_class(col("t")) != "html", lit(False))}, {"supported": "p_partkey % 4 < 2"})


@query("celex_reference", f"with {REGISTRY} select ord, type || '-' || substring(celex, 2, 4) || '-' || (substring(celex, 7)::int)::varchar as slug, ord % 2 = 0 as agrees, type as again, '/' || case when ord % 3 = 0 then 'de/' else '' end || type || '-' || substring(celex, 2, 4) || '-' || (substring(celex, 7)::int)::varchar || case when ord % 5 = 0 then '/article/6%281%29' else '' end as route from registry")
def celex_reference(spark, sf):
    own = refs.celex_reference(col("celex"))
    asked = F.when(col("ord") % 2 == 0, own["number"]).otherwise(lit("12345"))
    slug = refs.reference_slug(own["act_type"], own["year"], own["number"])
    route = refs.law_route(slug, col("celex"), lit("article"), F.when(col("ord") % 5 == 0, "6(1)"), F.when(col("ord") % 3 == 0, "de").otherwise("en"))
    return adapters.registry(spark, sf).select("ord", slug.alias("slug"), refs.celex_agrees(col("celex"), own["act_type"], own["year"], asked).alias("agrees"), refs.slug_reference(slug)["act_type"].alias("again"), route.alias("route"))


ASKED = "(select o_orderkey as id, case o_orderkey % 3 when 0 then 'regulation' when 1 then 'directive' else 'decision' end as kind, cast(1990 + o_custkey % 35 as string) as year, cast(o_custkey % 300 as string) as number, case when o_orderkey % 4 = 0 then 'JHA' else '' end as suffix from orders)"
STORED = "(select p_partkey, cast(1990 + p_size % 35 as string) as year, case p_partkey % 5 when 0 then 'reg' when 1 then 'dir' when 2 then 'dec' when 3 then 'dec_framw' else 'dec' end as path, case when p_partkey % 5 = 4 then '(1)' else '' end as mark, cast(p_partkey % 300 as string) as number from part)"


def made_from(rows: DataFrame, view: str) -> DataFrame:
    """The columns that ``view``, a subquery in parentheses on one table, makes of ``rows``."""
    return rows.sparkSession.sql(f"select * from {re.sub(' from [a-z]+[)]$', ' from {rows})', view.strip())}", rows=rows)


def asked_references(spark, sf):
    return made_from(table(spark, sf, "orders"), ASKED)


def stored_acts(spark, sf):
    eli = F.concat(lit(f"{refs.STORE}/"), "path", lit("/"), "year", lit("/"), "number", "mark", lit("/oj"))
    return made_from(table(spark, sf, "part"), STORED).select(eli.alias("eli"), F.format_string("act%07d", "p_partkey").alias("celex"))


TRIED = f"""asked as (select * from {ASKED}), acts as (select '{refs.STORE}/' || path || '/' || year || '/' || number || mark || '/oj' as eli, min(printf('act%07d', p_partkey)) as celex from {STORED} group by 1),
 tried as (select id, 0 as place, '{refs.STORE}/' || case kind when 'regulation' then 'reg' when 'directive' then 'dir' else 'dec_framw' end || '/' || year || '/' || number || '/oj' as eli from asked where kind <> 'decision' or suffix = 'JHA'
  union all select id, (suffix = 'JHA')::int, '{refs.STORE}/dec/' || year || '/' || number || '/oj' from asked where kind = 'decision' union all select id, 1 + (suffix = 'JHA')::int, '{refs.STORE}/dec/' || year || '/' || number || '(1)/oj' from asked where kind = 'decision'),
 hit as (select id, arg_min(celex, place) as celex, min(place) as place from tried join acts using (eli) group by 1)"""


def candidates():
    return refs.eli_candidates(col("kind"), col("year"), col("number"), col("suffix"))


@query("eli_candidates", f"with {TRIED} select id, place, eli from tried")
def eli_candidates(spark, sf):
    return asked_references(spark, sf).select("id", F.posexplode(candidates()).alias("place", "eli"))


@query("eli_resolve", f"with {TRIED} select id, celex, place from asked left join hit using (id)")
def eli_resolve(spark, sf):
    acts = stored_acts(spark, sf).groupBy("eli").agg(F.min("celex").alias("celex"))
    return library.first_hit(asked_references(spark, sf).select("id", candidates().alias("c")), "c", acts, "eli").select("id", "celex", "place")


@query("resolve_chain", f"with {TRIED}, {REGISTRY}, one as (select type as kind, substring(celex, 2, 4) as year, (substring(celex, 7)::int)::varchar as number, min(celex) as by_number from registry group by 1, 2, 3 having count(distinct celex) = 1) select id, case when celex is not null then 'eli' when by_number is not null then 'reference' else 'search' end as via, coalesce(celex, by_number) as celex from asked left join hit using (id) left join one using (kind, year, number)")
def resolve_chain(spark, sf):
    """By address first, then by type, year and number where these are one act's, else left to a search."""
    asked = asked_references(spark, sf)
    acts = stored_acts(spark, sf).groupBy("eli").agg(F.min("celex").alias("celex"))
    first = library.first_hit(asked.select("id", "kind", "year", "number", candidates().alias("c")), "c", acts, "eli")
    own = refs.celex_reference(col("celex"))
    one = adapters.registry(spark, sf).select("celex", own["act_type"].alias("kind"), own["year"].alias("year"), own["number"].alias("number")).groupBy("kind", "year", "number").agg(F.countDistinct("celex").alias("n"), F.min("celex").alias("by_number")).where("n = 1").drop("n")
    via = F.when(col("celex").isNotNull(), "eli").when(col("by_number").isNotNull(), "reference").otherwise("search")
    return first.join(one, ["kind", "year", "number"], "left").select("id", via.alias("via"), F.coalesce("celex", "by_number").alias("celex"))


@query("article_citations", f"with {CITES}, c as (select src, ord, citation, regexp_extract(citation, 'Article (\\d+)', 1) as a, regexp_extract(citation, '(\\d{{4}}/\\d+)$', 1) as yn from cites), x as (select src, ord, unnest([{{'i': 0, 't': citation}}, {{'i': 1, 't': 'Article ' || a || ' of the GDPR'}}, {{'i': 2, 't': 'Articles ' || a || ', 7 and 9 of the Charter'}}, {{'i': 3, 't': 'Article ' || a || '(2) TFEU'}}]) as e from c) select src, ord, e.i as place, e.t as citation from x")
def article_citations(spark, sf):
    """Citations in sentences of judgments, one of each kind and one said twice."""
    said = "concat('Having regard to ', citation, ', to Articles ', a, ', 7  and 9 of the Charter, article ', a, ' of the GDPR, ', 'Article ', a, ' of  the GDPR and Article ', a, '(2) TFEU')"
    rows = adapters.cites(spark, sf).withColumn("a", F.regexp_extract("citation", r"Article (\d+)", 1)).select("src", "ord", F.expr(said).alias("t"))
    found = rows.select("src", "ord", F.posexplode(citations.article_citations(col("t"))).alias("place", "citation"))
    return found.withColumn("citation", F.regexp_replace("citation", "^article", "Article"))


@query("citations_by_act", f"with {CITES}, {PIECES} select case when yn = '2016/679' then 'GDPR' else yn end as act, count(*) as n, array_to_string(list_distinct(list(regexp_extract(citation, 'Article (\\d+)', 1) order by regexp_extract(citation, 'Article (\\d+)', 1)::int)), ' ') as articles from pieces group by 1".replace("list_distinct(list(", "(list(distinct "))
def citations_by_act(spark, sf):
    pills = adapters.cites(spark, sf).select("src", "ord", citations.pill(col("citation")).alias("pill"))
    found = citations.structured(pills, ["src", "ord"])
    number = F.coalesce(F.regexp_extract("article", r"^(\d+)", 1).try_cast("int"), lit(999))
    return found.groupBy("act").agg(F.count(lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct(number.alias("n"), "article"))).alias("a")).select("act", "n", F.array_join("a.article", " ").alias("articles"))


# The library
OPENED = f"""{REGISTRY}, acts as (select celex, min(ord) as ord, min(title) as title from registry group by 1), bundled as (select celex, 'law' || ord as key, 'Bundled ' || ord as label from acts where ord % 10 = 0),
 meta as (select celex, case when ord % 7 = 0 then 'My ' || title end as label, case when ord % 2 = 0 then title end as raw, ord * 3 as added_at, case when ord % 4 <> 0 then ord % 500 end as last_opened from acts where ord % 5 = 0),
 cached as (select celex || '_EN_' || ord as key from acts where ord % 6 = 0)"""


def library_tables(spark, sf):
    acts = adapters.registry(spark, sf).groupBy("celex").agg(F.min("ord").alias("ord"), F.min("title").alias("title"))
    bundled = acts.where("ord % 10 = 0").selectExpr("celex", "concat('law', ord) as key", "concat('Bundled ', ord) as label")
    meta = acts.where("ord % 5 = 0").selectExpr("celex", "case when ord % 7 = 0 then concat('My ', title) end as label", "case when ord % 2 = 0 then title end as raw", "ord * 3 as added_at", "case when ord % 4 <> 0 then ord % 500 end as last_opened")
    return acts, bundled, meta, acts.where("ord % 6 = 0").selectExpr("concat(celex, '_EN_', ord) as key")


@query("library_laws", f"""with {OPENED}, keys as (select celex from meta union select string_split(key, '_')[1] from cached) select celex, coalesce(b.key, 'import:' || celex) as id, case when b.key is not null then 'bundled' else 'imported' end as kind, coalesce(m.label, b.label, raw, celex) as label,
 '/' || coalesce(b.key, case substring(celex, 6, 1) when 'R' then 'regulation' when 'L' then 'directive' else 'decision' end || '-' || substring(celex, 2, 4) || '-' || (substring(celex, 7)::int)::varchar) as route, last_opened, coalesce(added_at, 0) as added_at from keys left join meta m using (celex) left join bundled b using (celex) where last_opened > 0""")
def library_laws(spark, sf):
    _, bundled, meta, cached = library_tables(spark, sf)
    return library.library_laws(bundled, meta, cached)


@query("cached_laws", f"with {OPENED} select distinct string_split(key, '_')[1] as celex from cached")
def cached_laws(spark, sf):
    return library_tables(spark, sf)[3].select(F.substring_index("key", "_", 1).alias("celex")).distinct()


@query("uncached_laws", f"with {OPENED} select celex from acts where celex not in (select string_split(key, '_')[1] from cached)")
def uncached_laws(spark, sf):
    """Laws that aren't known to lack a document."""
    acts, _, _, cached = library_tables(spark, sf)
    return acts.select("celex").join(cached.select(F.substring_index("key", "_", 1).alias("celex")), "celex", "left_anti")


@query("stored_reference", f"with {REGISTRY}, m as (select ord, celex, type, substring(celex, 2, 4) as year, case when ord % 3 = 0 then '9999' else (substring(celex, 7)::int)::varchar end as number from registry), ok as (select type, year, number, arg_min(celex, ord) as celex from m where number = (substring(celex, 7)::int)::varchar group by 1, 2, 3), a as (select distinct type as act_type, year, number from m) select act_type, a.year, a.number, celex from a left join ok on act_type = ok.type and a.year = ok.year and a.number = ok.number")
def stored_reference(spark, sf):
    """References as stored, a third of them stale, and the laws that they still lead to."""
    own = refs.celex_reference(col("celex"))
    meta = adapters.registry(spark, sf).select("ord", "celex", own["act_type"].alias("act_type"), own["year"].alias("year"), F.when(col("ord") % 3 == 0, "9999").otherwise(own["number"]).alias("number"))
    return library.stored_by_reference(meta.select("act_type", "year", "number").distinct(), meta)


@query("recency_labels", f"with {REQUESTS}, d as (select id, ts, date_diff('day', ts::date, date '2024-01-20') as n from requests) select id, n as days, case when n = 0 then 'today' when n = 1 then 'yesterday' when n <= 6 then dayname(ts) when year(ts) = 2024 then strftime(ts, '%b %-d') else strftime(ts, '%b %-d, %Y') end as label from d")
def recency_labels(spark, sf):
    as_of = lit("2024-01-20").cast("date")
    return adapters.requests(spark, sf).select("id", F.datediff(as_of, "ts").alias("days"), library.recency_label(col("ts"), as_of).alias("label"))


@query("stale_entries", "select event_id from events where event_id % 7 = 0 or (event_id % 3 = 0 and ts < timestamp '2024-01-15 00:00:00' - interval 6 hour)")
def stale_entries(spark, sf):
    entries = table(spark, sf, "events").select("event_id", (col("event_id") % 7 == 0).alias("partial"), F.expr("case when event_id % 3 = 0 then ts end").alias("last_failed"))
    return library.stale(entries, F.expr("timestamp_ntz '2024-01-15 00:00:00'")).select("event_id")


@query("reenrich_candidates", f"with {REGISTRY} select celex, ord from registry where ord % 4 < 2")
def reenrich_candidates(spark, sf):
    """Primary acts whose title is missing or a placeholder."""
    titled = adapters.registry(spark, sf).withColumn("title", F.expr("case ord % 4 when 0 then ' ' when 1 then 'CORRELATION TABLE' else title end"))
    primary = (refs.eli_kind(col("eli")) == "primary") & ~refs.is_corrigendum(col("celex"))
    return titled.where(primary & text.registry_title(col("title")).isNull()).select("celex", "ord")


@query("case_filter", f"with {CITES}, c as (select src, min(citation) as name, list(citation) as cited from cites group by 1) select src from c where contains(lower(name), 'article 2(') or len(list_filter(cited, lambda x: contains(lower(x), 'article 2('))) > 0")
def case_filter(spark, sf):
    cases = adapters.cites(spark, sf).groupBy("src").agg(F.min("citation").alias("name"), F.collect_list("citation").alias("cited"))
    return library.cases_with(cases, "Article 2(", ["name"], ["cited"]).select("src")


@query("reference_kinds", f"with {EDGES} select law, count(*) filter (kind = 'amends') as forward, count(*) filter (kind in ('implements', 'interprets')) as external from edges group by 1")
def reference_kinds(spark, sf):
    return adapters.edges(spark, sf).groupBy("law").agg(F.count_if(col("kind") == "amends").alias("forward"), F.count_if(col("kind").isin("implements", "interprets")).alias("external"))


@query("run_summary", "select count(*) as processed, count(*) filter (o_orderstatus <> 'P') as successful, count(*) filter (o_orderstatus = 'F' and o_orderkey % 2 = 0) as with_operative, sum(o_custkey % 7) as citations from orders")
def run_summary(spark, sf):
    ok = col("o_orderstatus") != "P"
    return table(spark, sf, "orders").agg(F.count(lit(1)).alias("processed"), F.count_if(ok).alias("successful"), F.count_if((col("o_orderstatus") == "F") & (col("o_orderkey") % 2 == 0)).alias("with_operative"), F.sum(F.expr("o_custkey % 7")).alias("citations"))


@query("cache_sizes", "select page_id % 8 as bucket, count(*) as n, sum(length(html)) as chars, count(*) filter (length(html) < 2000) as partial from pages group by 1")
def cache_sizes(spark, sf):
    return table(spark, sf, "pages").groupBy((col("page_id") % 8).alias("bucket")).agg(F.count(lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"), F.count_if(F.length("html") < 2000).alias("partial"))


@query("searchable_laws", f"with {UNITS} select count(distinct doc_id) as laws, count(*) as units from units where trim(text) <> ''")
def searchable_laws(spark, sf):
    return adapters.units(spark, sf).where(F.trim("text") != "").agg(F.countDistinct("doc_id").alias("laws"), F.count(lit(1)).alias("units"))


@query("parsed_content", f"with {UNITS} select doc_id, max(case when trim(text) <> '' and kind = 'article' then 1 else 0 end) = 1 or max(case when trim(text) <> '' and kind = 'recital' then 1 else 0 end) = 1 as has_content from units group by 1")
def parsed_content(spark, sf):
    full = lambda kind: F.collect_list(F.when((col("kind") == kind) & (F.trim("text") != ""), col("ord")))
    return adapters.units(spark, sf).groupBy("doc_id").agg(full("article").alias("a"), full("recital").alias("r")).select("doc_id", ((F.size("a") > 0) | (F.size("r") > 0)).alias("has_content"))


@query("heavy_hitters", f"with {REQUESTS} select user_id, n from (select user_id, count(*) as n, max(id) as l from requests group by 1) order by n desc, l desc limit 100")
def heavy_hitters(spark, sf):
    return library.heavy_hitters(adapters.requests(spark, sf), "user_id", "id", 100)


LINES = "(select o_custkey, o_orderkey, case o_orderkey % 4 when 0 then 'CHAPTER ' || (o_orderkey % 9) when 1 then 'GENERAL RULES ' || o_custkey when 2 then 'Some text.' else 'Section 2' end as line from orders)"


@query("division_titles", f"select o_custkey, o_orderkey, number, title from (select o_custkey, o_orderkey, line as number, case when lead(o_orderkey) over w % 4 = 1 then lead(line) over w end as title from {LINES} window w as (partition by o_custkey order by o_orderkey)) where o_orderkey % 4 in (0, 3)")
def division_titles(spark, sf):
    lines = made_from(table(spark, sf, "orders"), LINES)
    return library.division_titles(lines, "o_custkey", "o_orderkey", "line", text.collapsed(col("line")).rlike(text.DIVISION_MARK), text.likely_division_title(col("line")))


@query("bundle_recitals", f"with {RECITALS} select doc_id, recital, max(score) as score from (select *, row_number() over (partition by doc_id, article order by score desc, recital) as p from links where article % 2 = 1) where p <= 6 group by 1, 2")
def bundle_recitals(spark, sf):
    units = adapters.units(spark, sf)
    return library.bundle_recitals(tfidf.recital_links(units), units.where("kind = 'article' and ord % 2 = 1").select("doc_id", col("ord").alias("article")))


@query("bundle_cases", f"with {CITES}, {PIECES}, r as (select src, regexp_extract(citation, 'Article (\\d+)', 1) as article, regexp_extract(citation, '\\((\\d+)\\)', 1) as paragraph from pieces where yn = '2005/50') select src, count(*) as n_refs, array_to_string(list_sort(list(article || '/' || paragraph || '/a')), ' ') as refs from r where article in ('1', '2') group by 1")
def bundle_cases(spark, sf):
    pills = adapters.cites(spark, sf).select("src", "ord", citations.pill(col("citation")).alias("pill"))
    chosen = spark.createDataFrame([("1",), ("2",)], "article string")
    return library.bundle_cases(citations.structured(pills, ["src", "ord"]), "2005/50", chosen)


@query("bundle_articles", f"with {UNITS} select doc_id, count(*) as articles, string_agg(ord, ' ' order by ord) as numbers, sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as chars from units where kind = 'article' and ord in (1, 3, 4) group by 1")
def bundle_articles(spark, sf):
    """The chosen articles of each law in their order."""
    units = adapters.units(spark, sf).where("kind = 'article' and ord in (1, 3, 4)")
    return units.groupBy("doc_id").agg(F.count(lit(1)).alias("articles"), F.array_join(F.array_sort(F.collect_list("ord")), " ").alias("numbers"), F.sum(F.length(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("chars"))


TERMS = "regexp_extract(lower(text), '([a-z]+ [a-z]{3,})', 1)"


@query("definitions_within", f"with {UNITS}, d as (select distinct doc_id, {TERMS} as term from units where kind = 'recital') select distinct u.doc_id, pos, term from units u join d using (doc_id) where term <> '' and contains(lower(text), term)")
def definitions_within(spark, sf):
    units = adapters.units(spark, sf)
    terms = units.where("kind = 'recital'").select("doc_id", F.regexp_extract(F.lower("text"), "([a-z]+ [a-z]{3,})", 1).alias("term")).where("term <> ''").distinct()
    return library.definitions_within(units, terms)


@query("definitions_by_length", f"with {UNITS}, t as (select doc_id, ord, {TERMS} as term from units where kind = 'recital') select doc_id, term, row_number() over (partition by doc_id order by length(term) desc, ord) as place from t where term <> ''")
def definitions_by_length(spark, sf):
    """The order in which a law's terms are looked for in its text: longest first."""
    terms = adapters.units(spark, sf).where("kind = 'recital'").select("doc_id", "ord", F.regexp_extract(F.lower("text"), "([a-z]+ [a-z]{3,})", 1).alias("term")).where("term <> ''")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("term")), "ord")
    return terms.select("doc_id", "term", F.row_number().over(order).alias("place"))


@query("registry_page", f"with {REGISTRY} select celex, date, ord from registry order by date desc, ord limit 20 offset 40")
def registry_page(spark, sf):
    """The third page of the registry, latest acts first."""
    return adapters.registry(spark, sf).orderBy(F.desc("date"), "ord").offset(40).limit(20).select("celex", "date", "ord")


@query("cases_by_date", f"with {EDGES} select law, date, ord from edges where act = 7 and kind = 'interprets' order by coalesce(date, '') desc, law, ord")
def cases_by_date(spark, sf):
    return adapters.edges(spark, sf).where("act = 7 and kind = 'interprets'").orderBy(F.desc(F.coalesce("date", lit(""))), "law", "ord").select("law", "date", "ord")


@query("sitemap_routes", f"with {REGISTRY}, r as (select distinct '/' || type || '-' || substring(celex, 2, 4) || '-' || (substring(celex, 7)::int)::varchar as base from registry), u as (select base as route from r union select base || '/article/' || i from r, (values (1), (2), (3)) t(i) union select '/') select route from u")
def sitemap_routes(spark, sf):
    """Every law's page and those of its first three articles, each once, in order."""
    own = refs.celex_reference(col("celex"))
    slug = refs.reference_slug(own["act_type"], own["year"], own["number"])
    none = lit(None).cast("string")
    pages = F.array(refs.law_route(slug, col("celex"), none, none, lit("en")), *(refs.law_route(slug, col("celex"), lit("article"), lit(str(k)), lit("en")) for k in (1, 2, 3)), lit("/"))
    return adapters.registry(spark, sf).select(F.explode(pages).alias("route")).distinct().orderBy("route")


@query("citations_migrated", "select o_orderkey, case when o_orderkey % 3 = 0 then 'kept' else '6 7 9' end as articles from orders")
def citations_migrated(spark, sf):
    """Stored cases of the older form get their structured references from the citations that they have."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("case when o_orderkey % 3 = 0 then array('kept') end").alias("refs"), F.array(lit("Art. 6(1) and 7 GDPR"), lit("Art. 9(2)(a) GDPR"), lit("no citation")).alias("cited"))
    form = r"^Art\.?\s+(.+?)\s+([A-Za-z]+|\d{2,4}/\d+)\s*$"
    tokens = F.flatten(F.transform(F.filter("cited", lambda c: c.rlike(form)), lambda c: F.split(F.regexp_replace(F.regexp_extract(c, form, 1), r"(?i)\s+and\s+", ", "), ",")))
    derived = F.array_distinct(F.filter(F.transform(tokens, lambda t: refs.article_parts(t)[0]), lambda a: a.isNotNull()))
    return rows.select("o_orderkey", F.array_join(F.coalesce("refs", derived), " ").alias("articles"))


@query("units_union", f"with {UNITS} select kind, count(*) as n, min(id) as first_id from (select kind, doc_id || '-' || ord as id from units union all select 'annex', 'page-' || page_id from pages) group by 1")
def units_union(spark, sf):
    """Units of all kinds of source as one table."""
    units = adapters.units(spark, sf).select("kind", F.concat_ws("-", "doc_id", "ord").alias("id"))
    annexes = table(spark, sf, "pages").select(lit("annex").alias("kind"), F.concat(lit("page-"), "page_id").alias("id"))
    return units.unionByName(annexes).groupBy("kind").agg(F.count(lit(1)).alias("n"), F.min("id").alias("first_id"))


FREQUENT = "select lang, word from (select lang, word, row_number() over (partition by lang order by count(*) desc, word) as place from (select lang, unnest(string_split_regex(lower(text), '[^a-z]+')) as word from documents) where length(word) between 2 and 4 group by 1, 2) where place <= 40"


@query("stopword_union", f"with l as ({FREQUENT}), own as (select distinct lang from documents), u as (select lang, word from l union select o.lang, l.word from own o join l on l.lang = 'en') select lang, count(*) as n, string_agg(word, ' ' order by word) as words from u group by 1")
def stopword_union(spark, sf):
    """The stopwords of English and of a language itself, each once; here a language's most frequent short words stand for them."""
    words = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) between 2 and 4")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    lists = words.groupBy("lang", "word").agg(F.count(lit(1)).alias("n")).withColumn("place", place).where("place <= 40").select("lang", "word")
    return library.stopwords(lists, table(spark, sf, "documents").select("lang")).groupBy("lang").agg(F.count(lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))


def spanned(words: str, definition: str) -> str:
    return f"""'<span class="defined-term" data-definition="' || {definition} || '" title="' || {definition} || '">{words}</span>'"""


@query("tooltip_inject", f"""select p_partkey as doc_id, '<p title="personal data">' || {spanned("Personal data", "p_name")} || ' and ' || {spanned("data", "'a &quot;fact&quot; &amp; more'")} || ', metadata, data-set</p><p>data ' || p_brand || '</p>' as html from part""")
def tooltip_inject(spark: SparkSession, sf: str) -> DataFrame:
    """Two terms of each law, one within the other, in its text."""
    laws = spread(table(spark, sf, "part")).select(col("p_partkey").alias("doc_id"), F.expr("""concat('<p title="personal data">Personal data and data, metadata, data-set</p><p>data ', p_brand, '</p>')""").alias("html"), "p_name")
    entry = lambda place, term, meaning: F.struct(lit(place).alias("place"), lit(term).alias("term"), meaning.alias("definition"))
    terms = F.explode(F.array(entry(1, "data", lit('a "fact" & more')), entry(2, "personal data", col("p_name"))))
    return tooltips.with_tooltips(laws.drop("p_name"), laws.select("doc_id", terms.alias("t")).select("doc_id", "t.*"))
