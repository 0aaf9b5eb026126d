"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from lexspark.functions.refs import ACT_CELEX
from lexspark.functions.text import ACRONYM_STOPWORDS, STOPWORDS_EN
from lexspark.operators.search import QUERY_REWRITES


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


STOP = f"[{words(STOPWORDS_EN)}]"
NORMAL = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = f"list_filter(string_split_regex(regexp_replace(lower({{0}}), '[^0-9A-Za-z_\\sÀ-ɏ]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 and not list_contains({STOP}, t))"

REGISTRY = """registry as (select p_partkey as ord, '3' || (1990 + p_size % 35) || case p_partkey % 3 when 0 then 'R' when 1 then 'L' else 'D' end || lpad((p_partkey % 10000)::varchar, 4, '0') as celex,
 p_name as title, case p_partkey % 3 when 0 then 'regulation' when 1 then 'directive' else 'decision' end as type,
 (1990 + p_size % 35) || '-' || lpad((1 + p_size % 12)::varchar, 2, '0') || '-01' as date,
 'http://data.europa.eu/eli/' || case p_partkey % 3 when 0 then 'reg' when 1 then 'dir' else 'dec' end || '/' || (1990 + p_size % 35) || '/' || (p_partkey % 10000) || '/oj' as eli from part)"""
UNITS = """lines as (select doc_id, lang, string_split(text, chr(10)) as l from documents),
 units as (select doc_id, lang, case when i <= len(l) // 2 then 'recital' else 'article' end as kind, case when i <= len(l) // 2 then i else i - len(l) // 2 end as ord, i as pos, l[i] as text
 from (select doc_id, lang, l, unnest(generate_series(1, len(l))) as i from lines))"""
CITES = "cites as (select l_orderkey as src, l_linenumber as ord, l_partkey as act, 'Article ' || l_linenumber || '(' || l_quantity::int || ')(a) of Regulation (EU) ' || (1990 + l_suppkey % 35) || '/' || l_partkey as citation from lineitem)"
REQUESTS = """requests as (select event_id as id, ts, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.7' as ip, '/api/' || event_type as route, case when event_id % 10 = 0 then 500 else 200 end as status,
 'q' || (user_id % 40) as q, user_id from events)"""
EDGES = "edges as (select l_orderkey as law, l_partkey as act, case l_returnflag when 'A' then 'amends' when 'N' then 'implements' else 'interprets' end as kind, strftime(l_shipdate, '%Y-%m-%d') as date, l_linenumber as ord from lineitem)"
PIECES = """pieces as (select src, ord, act as target, nullif(regexp_extract(citation, '(\\d{4}/\\d+)$', 1), '') as yn, citation from cites),
 pills as (select src, ord, 'Art. ' || regexp_extract(citation, 'Article (\\S+)', 1) || case when yn = '2016/679' then ' GDPR' else ' ' || yn end as pill from pieces)"""
TF_DOCS = f"terms as (select doc_id, unnest({TOKENS.format('text')}) as term from documents), tf as (select doc_id, term, count(*) as tf from terms group by all), n as (select count(*) as n from documents), idf as (select term, df, log10(n / df) as idf from (select term, count(*) as df from tf group by term), n)"
DIVIDED = f"""{UNITS}, marked as (select *, case when pos % 7 = 1 then pos end as ch, case when pos % 3 = 0 then pos end as sh from units),
 with_ch as (select *, max(ch) over (partition by doc_id order by pos) as chapter from marked),
 divided as (select *, max(sh) over (partition by doc_id, chapter order by pos) as section from with_ch)"""
RECITALS = f"""{UNITS}, t as (select doc_id, kind, ord, unnest({TOKENS.format('text')}) as term from units), tf as (select doc_id, kind, ord, term, count(*) as tf from t group by all),
 na as (select doc_id, count(*) as n from units where kind = 'article' group by 1), nr as (select doc_id, count(*) as n from units where kind = 'recital' group by 1),
 idf as (select doc_id, term, log10(n / df) as idf from (select doc_id, term, count(*) as df from tf where kind = 'article' group by all) join na using (doc_id)),
 w as (select doc_id, kind, ord, term, tf * idf as w from tf join idf using (doc_id, term)), m as (select doc_id, kind, ord, sqrt(sum(w * w)) as m from w group by all),
 dot as (select r.doc_id, r.ord as recital, a.ord as article, sum(r.w * a.w) as dot from w r join w a on r.doc_id = a.doc_id and r.term = a.term and r.kind = 'recital' and a.kind = 'article' group by all),
 raw as (select d.doc_id, recital, article, round(case when mr.m > 0 and ma.m > 0 then dot / (mr.m * ma.m) else 0 end, 9) as raw, power(1 - 0.9 * abs((recital - 1) / greatest(nr.n - 1, 1) - (article - 1) / greatest(na.n - 1, 1)), 2) as prior
  from dot d join m mr on mr.doc_id = d.doc_id and mr.kind = 'recital' and mr.ord = recital join m ma on ma.doc_id = d.doc_id and ma.kind = 'article' and ma.ord = article join nr on nr.doc_id = d.doc_id join na on na.doc_id = d.doc_id),
 scores as (select doc_id, recital, article, raw, round(raw * prior, 9) as score from raw),
 ranked as (select *, max(score) over p as best, max(raw) over p as best_raw, row_number() over (partition by doc_id, recital order by score desc, article) as place from scores window p as (partition by doc_id, recital)),
 links as (select doc_id, recital, article, round(score, 6) as score from ranked where best_raw >= 0.15 and best > 0 and score >= 0.75 * best and place <= 2)"""
ACT_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in ACT_CELEX.items())

SQL: dict[str, str] = {
    "text_normalize": f"select doc_id, {NORMAL.format('text')} as normal from documents",
    "text_compact": f"select doc_id, replace({NORMAL.format('text')}, ' ', '') as compact from documents",
    "text_tokenize": f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {TOKENS.format('text')} as t from documents)",
    "token_stopwords": f"select w as word, count(*) as n from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents) where list_contains({STOP}, w) group by 1",
    "html_strip_tags": "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages",
    "html_title_extract": "select page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title from pages",
    "html_links": "select page_id, len(l) as n_links, array_to_string(l, ' ') as links from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as l from pages)",
    "text_clip": "select doc_id, case when length(text) > 200 then rtrim(substring(text, 1, 200), ' ') || '...' else text end as clip, case when length(text) > 160 then trim(substring(text, 1, 159), ' ') || '…' else text end as summary from documents",
    "text_escape": "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from pages",
    "slugify": "select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part",
    "acronym_variants": f"""select p_partkey, case when length(a) between 2 and 8 then a else '' end as variants from (select p_partkey, array_to_string(list_transform(list_filter(string_split({NORMAL.format("p_name || ' ' || p_type")}, ' '),
      lambda w: w <> '' and not list_contains([{words(ACRONYM_STOPWORDS)}], w)), lambda w: case when regexp_matches(w, '[0-9]') then w else substring(w, 1, 1) end), '') as a from part)""",
    "celex_parse": f"with {REGISTRY} select ord, celex, regexp_matches(celex, '^\\d{{5}}[A-Z]{{1,2}}\\d{{4}}(\\([0-9]+\\))?$') as valid, nullif(regexp_extract(celex, '^3(\\d{{4}})[RLD]0*\\d{{1,4}}', 1), '') as year, nullif(regexp_extract(celex, '^3\\d{{4}}[RLD]0*(\\d{{1,4}})', 1), '') as number, type from registry",
    "eli_kind": f"with {REGISTRY} select ord, 'primary' as kind, lower(regexp_replace(eli, '/+$', '')) as key from registry",
    "official_ref_key": f"with {REGISTRY} select ord, type || '|' || substring(celex, 2, 4) || '|' || (substring(celex, 7)::int)::varchar as key from registry",
    "case_number_celex": "select p_partkey, '6' || case when p_size % 100 > 50 then '19' else '20' end || lpad((p_size % 100)::varchar, 2, '0') || 'CJ' || lpad((p_partkey % 10000)::varchar, 4, '0') as celex, 'C-' || (p_partkey % 10000) || '/' || lpad((p_size % 100)::varchar, 2, '0') as again from part",
    "ref_parse_backend": f"with {CITES} select src, ord, 'regulation' as act_type, regexp_extract(citation, '\\b(\\d{{4}})/(\\d{{1,4}})\\b', 1) as year, regexp_extract(citation, '\\b(\\d{{4}})/(\\d{{1,4}})\\b', 2) as number from cites",
    "ref_parse_official": """with o as (select o_orderkey, case when o_orderkey % 2 = 0 then 'Directive ' || (o_orderkey % 100) || '/' || (o_custkey % 10000) || '/EC' else 'Regulation (EU) ' || (1990 + o_orderkey % 30) || '/' || (o_custkey % 10000) end as c from orders),
 p as (select o_orderkey, regexp_extract(c, '\\b(\\d{4})/(\\d{1,4})', 1) as a, regexp_extract(c, '\\b(\\d{4})/(\\d{1,4})', 2) as b, regexp_extract(c, '\\b(\\d{1,4})/(\\d{2,4})', 1) as e, regexp_extract(c, '\\b(\\d{1,4})/(\\d{2,4})', 2) as f from o)
 select o_orderkey, case when a <> '' then a when length(e) = 2 then (case when e::int >= 50 then 1900 else 2000 end + e::int)::varchar else nullif(e, '') end as year, case when a <> '' then b else nullif(f, '') end as number from p""",
    "ip_truncate": f"with {REQUESTS} select id, regexp_replace(ip, '^(\\d+\\.\\d+\\.\\d+)\\.\\d+$', '\\1.0') as ip from requests",
    "unique_match_join": f"with {REGISTRY}, one as (select celex, min(title) as title from registry group by celex having count(*) = 1) select r.ord, r.celex, o.title as match_title from registry r left join one o using (celex)",
    "supplement_antijoin": f"with {REGISTRY}, s as (select '32000L0031' as celex union all select '32002L0058' union all select celex from registry where ord < 5) select celex from registry union all select celex from s where celex not in (select celex from registry)",
    "fallback_resolve": f"with {REGISTRY}, {CITES}, hits as (select substring(celex, 2, 4) as year, (substring(celex, 7)::int)::varchar as number, count(distinct celex) as hits, min(celex) as celex from registry group by all), c as (select src, ord, regexp_extract(citation, '\\b(\\d{{4}})/(\\d{{1,4}})\\b', 1) as year, regexp_extract(citation, '\\b(\\d{{4}})/(\\d{{1,4}})\\b', 2) as number from cites) select src, ord, case when hits = 1 then 'resolved' when hits > 1 then 'ambiguous' else 'none' end as state, case when hits = 1 then celex end as celex from c left join hits using (year, number)",
    "tf": f"with {TF_DOCS} select doc_id, term, tf from tf",
    "idf": f"with {TF_DOCS} select term, df, round(idf, 6) as idf from idf",
    "doc_magnitude": f"with {TF_DOCS} select doc_id, round(sqrt(sum(tf * idf * tf * idf)), 6) as magnitude from tf join idf using (term) group by 1",
    "content_search": f"""with {TF_DOCS}, q as (select term, count(*) as tf from (select unnest({TOKENS.format("'there thention anonst'")}) as term) group by 1), qw as (select term, q.tf * idf as qw from q join idf using (term)), w as (select doc_id, term, tf * idf as w from tf join idf using (term)),
      c as (select doc_id, sum(w * qw) / (max(m) * max(qn)) as cosine from w join qw using (term) join (select doc_id, sqrt(sum(w * w)) as m from w group by 1) using (doc_id), (select sqrt(sum(qw * qw)) as qn from qw) group by 1)
      select doc_id, round(100 * coalesce(cosine, 0) + case when contains(lower(string_split(text, chr(10))[1]), 'there thention anonst') then 50 else 0 end, 6) as score from documents left join c using (doc_id) where round(100 * coalesce(cosine, 0) + case when contains(lower(string_split(text, chr(10))[1]), 'there thention anonst') then 50 else 0 end, 6) > 0.5""",
    "substring_fallback": "select doc_id, 1.0::double as score from documents where contains(lower(text), 'the of')",
    "recital_links": f"with {RECITALS} select * from links",
    "recital_orphans": f"with {RECITALS} select doc_id, ord as recital from units u where kind = 'recital' and not exists (select 1 from links l where l.doc_id = u.doc_id and l.recital = u.ord)",
    "recital_keywords": f"with {RECITALS} select doc_id, ord as recital, place, term from (select doc_id, ord, term, row_number() over (partition by doc_id, ord order by idf desc, term) as place from tf join idf using (doc_id, term) where kind = 'recital') where place <= 3",
    "citation_pills": f"with {CITES}, {PIECES} select src, ord, pill from pills",
    "citation_refs": f"with {CITES}, {PIECES} select src, ord, case when yn = '2016/679' then 'GDPR' else yn end as act, case case when yn = '2016/679' then 'GDPR' else yn end {ACT_MAP} end as act_celex, regexp_extract(citation, 'Article (\\d+)', 1) as article, regexp_extract(citation, '\\((\\d+)\\)', 1) as paragraph, 'a' as point from pieces",
    "composite_split": "select o_orderkey, unnest([(o_orderkey % 9)::varchar, (o_orderkey % 5 + 10)::varchar, (o_orderkey % 7 + 20)::varchar]) as article, 'GDPR' as act from orders",
    "cases_for_article": f"with {CITES}, {PIECES} select distinct src from pieces where yn = '2005/50' and regexp_extract(citation, 'Article (\\d+)', 1) = '1'",
    "range_expand": "select o_orderkey as src, unnest(case when o_custkey % 60 <= 50 then generate_series(o_orderkey % 50, o_orderkey % 50 + o_custkey % 60) else [o_orderkey % 50] end) as article from orders",
    "back_references": f"with {EDGES} select act, count(distinct law) as n_sources, min(law) as first_source from edges where law <> act group by 1",
    "external_overview": f"with {EDGES} select act, count(*) as n, arg_min(kind, (law, ord, kind)) as first_kind from edges group by 1",
    "related_instruments": f"with {EDGES} select act, count(*) as n, arg_min(kind, (law, ord, kind)) as first_kind from edges group by 1 order by n desc, act limit 12",
    "definitions_used": "with d as (select item_id, regexp_extract(lower(text), '([a-z]{6,})', 1) as term from benchmark), w as (select distinct doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as term from documents) select distinct doc_id, item_id from w join d using (term)",
    "division_carry_forward": f"with {DIVIDED} select doc_id, pos, chapter, section from divided",
    "toc_group": f"with {DIVIDED} select doc_id, chapter, section, min(pos) as first_pos, count(*) as items, row_number() over (partition by doc_id order by min(pos)) as place from divided group by doc_id, chapter, section",
    "header_changes": f"with {DIVIDED} select doc_id, pos, chapter from (select *, lag(chapter) over (partition by doc_id order by pos) as b from divided) where chapter is not null and (b is null or b <> chapter)",
    "flat_sessionize": f"with {UNITS}, g as (select *, sum(case when length(text) < 40 then 1 else 0 end) over (partition by doc_id order by pos) as grp from units) select doc_id, grp, min(pos) as heading_pos, count(*) as n_lines, sum(length(text)) as n_chars from g where grp > 0 group by 1, 2",
    "prev_next": f"with {UNITS} select doc_id, pos, lag(pos) over w as prev_pos, lead(pos) over w as next_pos from units window w as (partition by doc_id order by pos)",
    "batch_35": f"with {UNITS} select doc_id, (pos - 1) // 35 as batch, count(*) as n, min(pos) as first_pos from units group by 1, 2",
    "bilingual_align": f"with {UNITS}, v as (select doc_id, doc_id // 20 as law, row_number() over (partition by doc_id // 20, lang order by doc_id) as version from documents), u as (select * from units join v using (doc_id)), two as (select law, version, kind, ord, length(text) as other_chars from u where lang = 'fr') select law, version, kind, ord, length(text) as chars, other_chars from u left join two using (law, version, kind, ord) where u.lang = 'en'",
    "graph_amendments": f"with {EDGES} select distinct law, date, ord from edges where act = 7 and kind = 'amends' order by date, law, ord limit 50",
    "graph_implementing": f"with {EDGES} select distinct law, date, ord from edges where act = 7 and kind = 'implements' order by date, law, ord limit 100",
    "graph_cases": f"with {EDGES}, {REGISTRY} select celex, count(distinct law) as n_cases, max(e.date) as latest from edges e join registry r on e.act = r.ord where kind = 'interprets' group by 1",
    "graph_metadata": f"with {EDGES}, {REGISTRY}, d as (select act, min(date) as f, max(date) as l, count(distinct date) as n from edges where kind = 'amends' group by 1) select celex, r.ord as ord_key, f as first_amended, l as last_amended, coalesce(n, 0) as n_dates from registry r left join d on d.act = r.ord",
    "grounded_citations": f"with {CITES} select c.src, count(*) as n_proposed, count(*) filter (c.act % 3 = 0 and p.p_partkey is not null) as n_valid from cites c left join part p on p.p_partkey = c.act group by 1",
    "planner_filter": f"with {CITES}, v as (select src, act, min(ord) as ord from cites where act % 2 = 0 group by all) select src, act, place from (select *, row_number() over (partition by src order by ord, act) as place from v) where place <= 10",
    "json_extract": "select event_id, json_extract_string(props, '$.k') as k from events",
    "content_hash": "select doc_id, sha256(doc_id || chr(31) || text) as hash from documents",
    "evict_fifo": "select key, bucket, size from (select page_id as key, page_id % 8 as bucket, length(html) as size, coalesce(sum(length(html)) over (partition by page_id % 8 order by page_id rows between unbounded preceding and 1 preceding), 0) as b from pages) where b < 20000",
    "prune_recency": "select key, owner from (select event_id as key, user_id as owner, row_number() over (partition by user_id order by ts desc, event_id) as p from events) where p > 5",
    "ttl_live": "select event_id from events where ts + interval 21600 second > timestamp '2024-01-15 00:00:00'",
    "retain_last_90": f"with {REQUESTS} select strftime(ts, '%Y-%m-%d') as day, count(*) as n from requests group by 1 order by 1 desc limit 90",
    "daily_usage": f"with {REQUESTS} select strftime(ts, '%Y-%m-%d') as day, count(*) as n_requests, count(distinct ip) as n_ips from requests group by 1",
    "top_routes": f"with {REQUESTS} select route, n from (select route, count(*) as n, min(id) as f from requests where status < 500 group by 1) order by n desc, f limit 20",
    "top_searches": f"with {REQUESTS} select q, n from (select q, count(*) as n, min(id) as f from requests where status < 500 group by 1) order by n desc, f limit 20",
    "recency_islands": f"with {REQUESTS}, d as (select *, strftime(ts, '%Y-%m-%d') as day from requests), c as (select *, case when lag(day) over (partition by user_id order by ts, id) = day then 0 else 1 end as ch from d), i as (select *, sum(ch) over (partition by user_id order by ts, id rows unbounded preceding) as island from c) select user_id, island, day, count(*) as n from i group by 1, 2, 3",
    "upsert_merge": "select c_custkey, c_name as name, case when c_custkey % 3 = 0 then 'new' else 'old' end as state from customer",
    "ref_parse_external": """with c as (select o_orderkey, case o_orderkey % 4 when 0 then lpad((o_orderkey % 100)::varchar, 2, '0') || '/' || (o_custkey % 1000) when 1 then (1000 + o_custkey % 1100) || '/' || (o_orderkey % 100) || '/EEC'
 when 2 then (1950 + o_orderkey % 70) || '/' || o_custkey else (100 + o_custkey % 900) || '/' || (1990 + o_orderkey % 30) end as t from orders), p as (select o_orderkey, string_split(t, '/')[1] as a, string_split(t, '/')[2] as b from c)
 select o_orderkey, case when length(a) = 4 then a when length(b) = 4 then b when length(a) = 2 then (case when a::int >= 50 then 1900 else 2000 end + a::int)::varchar end as year, case when length(a) = 4 then b when length(b) = 4 then a when length(a) = 2 then b end as number from p""",
    "query_rewrite": f"select event_id, [{words([*QUERY_REWRITES.values(), 'data act'])}][event_id % {len(QUERY_REWRITES) + 1} + 1] as query from events",
    "oj_ambiguity": f"""with {REGISTRY}, h as (select substr(celex, 2, 4) as year, (ord % 50)::varchar as number, count(distinct type) as n, min(type) as t from registry group by 1, 2), o as (select o_orderkey, (1980 + o_orderkey % 50)::varchar as year, (o_custkey % 60)::varchar as number from orders)
 select o_orderkey, year, number, case when n = 1 then 'accepted' when n > 1 then 'ambiguous' else 'none' end as state, case when n = 1 then t end as type from o left join h using (year, number)""",
    "xref_extract": """with o as (select o_orderkey, o_orderkey % 40 as a, o_custkey % 9 as d, o_custkey % 30 as b, o_custkey % 7 as c from orders)
 select o_orderkey, 0 as ord, a as "first", a + d as "last" from o union all select o_orderkey, 1, b, b from o union all select o_orderkey, 2, c, c + 3 from o""",
    "parse_formex": f"with {UNITS} select doc_id, kind, ord as ordinal, ord::varchar as number, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as text from units",
    "stream_upsert": "select user_id, arg_max(event_id, (ts, event_id)) as id from events group by 1",
}
