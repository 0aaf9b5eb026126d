"""The registered queries of the library's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import refs, text
from lexspark.operators import citations, graph, search, structure, tfidf, usage
from lexspark.plans import crossrefs, flat_laws, grounded, html_laws, inputs, judgments, library, proposals
from lexspark.plans.oracle import SQL
from lexspark.sources import adapters, formex
from lexspark.sources.adapters import table
from lexspark.streaming import upserts
from lexspark.streaming import usage as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on(name: str, source, plan) -> None:
    """Register a query that applies ``plan`` to a table or an adapter's view."""
    QUERIES[name] = lambda spark, sf: plan(table(spark, sf, source) if isinstance(source, str) else source(spark, sf))


col = F.col
docs, pages, part = "documents", "pages", "part"
on("text_normalize", docs, lambda d: d.select("doc_id", text.normalized(col("text")).alias("normal")))
on("text_compact", docs, lambda d: d.select("doc_id", text.compact(col("text")).alias("compact")))
on("text_tokenize", docs, lambda d: d.select("doc_id", text.tokens(col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens")))
on("token_stopwords", docs, lambda d: d.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(col("word").isin(text.STOPWORDS_EN)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
on("html_strip_tags", pages, lambda d: d.select("page_id", text.without_tags(col("html")).alias("text")))
on("html_title_extract", pages, lambda d: d.select("page_id", text.first_match(col("html"), "<title>([^<]*)</title>").alias("title")))
on("html_links", pages, lambda d: d.select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"')).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links")))
on("text_clip", docs, lambda d: d.select("doc_id", text.clipped(col("text"), 200).alias("clip"), text.summarized(col("text")).alias("summary")))
on("text_escape", pages, lambda d: d.select("page_id", text.escaped(col("html")).alias("escaped")))
on("slugify", part, lambda d: d.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug")))
on("acronym_variants", part, lambda d: d.select("p_partkey", F.array_join(text.acronym_variants(F.concat_ws(" ", "p_name", "p_type")), " ").alias("variants")))
on("celex_parse", adapters.registry, lambda d: d.select("ord", "celex", refs.is_celex(col("celex")).alias("valid"), refs.celex_year(col("celex")).alias("year"), refs.celex_number(col("celex")).alias("number"), refs.celex_type(col("celex")).alias("type")))
on("eli_kind", adapters.registry, lambda d: d.select("ord", refs.eli_kind(col("eli")).alias("kind"), refs.eli_key(col("eli")).alias("key")))
on("official_ref_key", adapters.registry, lambda d: d.select("ord", refs.official_ref_key(refs.celex_type(col("celex")), F.substring("celex", 2, 4), F.substring("celex", 7, 4)).alias("key")))
on("case_number_celex", part, lambda d: d.select("p_partkey", F.expr("concat('C-', p_partkey % 10000, '/', lpad(cast(p_size % 100 as string), 2, '0'))").alias("c")).select("p_partkey", refs.case_to_celex(col("c")).alias("celex"), refs.celex_to_case(refs.case_to_celex(col("c"))).alias("again")))
in_text = lambda found: F.when(col("citation").isNotNull(), F.coalesce(found, F.lit("")))  # '' where a text has none
on("ref_parse_backend", adapters.cites, lambda d: d.select("src", "ord", refs.act_type(col("citation")).alias("act_type"), in_text(refs.reference_year(col("citation"))).alias("year"), in_text(refs.reference_number(col("citation"))).alias("number")))
on("ip_truncate", adapters.requests, lambda d: d.select("id", refs.truncated_ip(col("ip")).alias("ip")))
on("citation_pills", adapters.cites, lambda d: d.select("src", "ord", citations.pill(col("citation")).alias("pill")))
on("back_references", adapters.edges, citations.back_references)
on("external_overview", adapters.edges, citations.external_overview)
on("related_instruments", adapters.edges, citations.top_related)
on("graph_amendments", adapters.edges, lambda d: graph.related(d, 7, "amends", 50))
on("graph_implementing", adapters.edges, lambda d: graph.related(d, 7, "implements", 100))
on("tf", docs, lambda d: tfidf.tf(tfidf.dealt(d, ["doc_id"]), ["doc_id"]))
on("idf", docs, lambda d: tfidf.idf(tfidf.tf(tfidf.dealt(d, ["doc_id"]), ["doc_id"]), d.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", F.round("idf", 6).alias("idf")))
on("doc_magnitude", docs, lambda d: tfidf.magnitudes(tfidf.weighted(d, ["doc_id"]), ["doc_id"]).select("doc_id", F.round("magnitude", 6).alias("magnitude")))
on("content_search", docs, lambda d: tfidf.content_search(d.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title")), "there thention anonst"))
on("substring_fallback", docs, lambda d: tfidf.substring_fallback(d, "the of"))
on("recital_links", adapters.units, tfidf.recital_links)
on("recital_orphans", adapters.units, tfidf.recital_orphans)
on("recital_keywords", adapters.units, tfidf.recital_keywords)
on("flat_sessionize", adapters.units, lambda d: structure.sessionized(d, "length(text) < 40"))
on("prev_next", adapters.units, structure.neighbours)
on("batch_35", adapters.units, structure.batches)
divided = lambda d: structure.carried_divisions(d, "pos % 7 = 1", "pos % 3 = 0")
on("division_carry_forward", adapters.units, lambda d: divided(d).select("doc_id", "pos", "chapter", "section"))
on("toc_group", adapters.units, lambda d: structure.toc(divided(d)))
on("header_changes", adapters.units, lambda d: structure.header_changes(divided(d)))
on("retain_last_90", adapters.requests, usage.retained_days)
on("daily_usage", adapters.requests, usage.daily)
on("top_routes", adapters.requests, lambda d: usage.top(d, "route"))
on("top_searches", adapters.requests, lambda d: usage.top(d, "q"))
on("recency_islands", adapters.requests, usage.recency_islands)
on("rate_limit", adapters.requests, lambda d: usage.rate_limited(d.withColumn("ip", refs.truncated_ip(col("ip")))))
on("json_extract", "events", lambda d: d.select("event_id", F.get_json_object("props", "$.k").alias("k")))
on("content_hash", docs, lambda d: d.select("doc_id", F.sha2(F.concat_ws("\x1f", "doc_id", "text"), 256).alias("hash")))
on("evict_fifo", pages, lambda d: usage.evicted(d.select(col("page_id").alias("key"), (col("page_id") % 8).alias("bucket"), F.length("html").cast("long").alias("size"), col("page_id").alias("mtime")), 20_000))
on("prune_recency", "events", lambda d: usage.pruned(d.select(col("event_id").alias("key"), col("user_id").alias("owner"), col("ts").alias("recency")), 5, "owner"))
on("ttl_live", "events", lambda d: d.where("ts + interval 21600 seconds > timestamp_ntz '2024-01-15 00:00:00'").select("event_id"))


@register
def ref_parse_official(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new forms of official citations, made from order keys."""
    short = "concat('Directive ', o_orderkey % 100, '/', o_custkey % 10000, '/EC')"
    new = "concat('Regulation (EU) ', 1990 + o_orderkey % 30, '/', o_custkey % 10000)"
    year, number = refs.official_year_number(col("c"))
    return table(spark, sf, "orders").select("o_orderkey", F.expr(f"case when o_orderkey % 2 = 0 then {short} else {new} end").alias("c")).select("o_orderkey", year.alias("year"), number.alias("number"))


@register
def record_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return search.enriched(adapters.registry(spark, sf)).select("ord", "celex", "n_title", "kind", "celex_year", "celex_number", "is_primary", F.array_join("aliases", "|").alias("aliases"))


@register
def alias_explode(spark: SparkSession, sf: str) -> DataFrame:
    return search.enriched(adapters.registry(spark, sf)).select("ord", F.explode("aliases").alias("alias"))


@register
def law_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.law_search(adapters.registry(spark, sf), "cold widget directive")


@register
def law_match_reason(spark: SparkSession, sf: str) -> DataFrame:
    q = search.parsed_query("regulation 2014/24")
    return search.enriched(adapters.registry(spark, sf)).select("ord", search.match_reason(q).alias("match_reason"), search.law_score(q).alias("score"))


@register
def unique_match_join(spark: SparkSession, sf: str) -> DataFrame:
    records = adapters.registry(spark, sf)
    titled = records.select("celex", col("title").alias("t")).groupBy("celex").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("match_title")).where("n = 1").drop("n")
    return records.select("ord", "celex").join(titled, "celex", "left").select("ord", "celex", "match_title")


@register
def supplement_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    records = adapters.registry(spark, sf).select("ord", "celex")
    more = spark.createDataFrame([("32000L0031",), ("32002L0058",)], "celex string").union(records.where("ord < 5").select("celex"))
    return search.with_supplements(records, more).select("celex")


@register
def fallback_resolve(spark: SparkSession, sf: str) -> DataFrame:
    records = adapters.registry(spark, sf).select("celex", refs.celex_year(col("celex")).alias("celex_year"), refs.celex_number(col("celex")).alias("celex_number"))
    asked = adapters.cites(spark, sf).select("src", "ord", refs.reference_year(col("citation")).alias("year"), refs.reference_number(col("citation")).alias("number"))
    return search.resolved(asked, records).select("src", "ord", "state", "celex")


def cited(spark: SparkSession, sf: str) -> DataFrame:
    pills = adapters.cites(spark, sf).select("src", "ord", citations.pill(col("citation")).alias("pill"))
    return citations.structured(pills, ["src", "ord"])


@register
def citation_refs(spark: SparkSession, sf: str) -> DataFrame:
    return cited(spark, sf).select("src", "ord", "act", "act_celex", "article", "paragraph", "point")


@register
def composite_split(spark: SparkSession, sf: str) -> DataFrame:
    pills = table(spark, sf, "orders").select("o_orderkey", F.expr("concat('Art. ', o_orderkey % 9, ', ', o_orderkey % 5 + 10, ' and ', o_orderkey % 7 + 20, ' GDPR')").alias("pill"))
    return citations.structured(pills, ["o_orderkey"]).select("o_orderkey", "article", "act")


@register
def cases_for_article(spark: SparkSession, sf: str) -> DataFrame:
    return citations.cases_for_article(cited(spark, sf), "src", "2005/50", "1")


@register
def range_expand(spark: SparkSession, sf: str) -> DataFrame:
    ranges = table(spark, sf, "orders").select(col("o_orderkey").alias("src"), F.expr("o_orderkey % 50").alias("first"), F.expr("o_orderkey % 50 + o_custkey % 60").alias("last"))
    return citations.expanded_ranges(ranges)


@register
def definitions_used(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), "([a-z]{6,})", 1).alias("term"))
    return citations.definitions_used(table(spark, sf, "documents"), terms)


@register
def bilingual_align(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a law in one language with the line at the same place in the other; a law has up to 20 documents, which
    count per language."""
    number = F.row_number().over(structure.Window.partitionBy("law", "lang").orderBy("doc_id"))
    numbered = table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 20").alias("law"), "lang").withColumn("version", number).drop("lang")
    units = adapters.units(spark, sf).join(numbered, "doc_id")
    return structure.aligned(units, "en", "fr", ["law", "version", "kind", "ord"])


def laws(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.registry(spark, sf).select("celex", col("ord").alias("ord_key"))


@register
def graph_cases(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cases(adapters.edges(spark, sf), laws(spark, sf))


@register
def graph_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return graph.metadata(laws(spark, sf), adapters.edges(spark, sf))


@register
def grounded_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed citations of each source, and those that exist and are allowed."""
    known = table(spark, sf, "part").where("p_partkey % 3 = 0").select(col("p_partkey").alias("act"), F.lit(1).alias("ok"))
    return adapters.cites(spark, sf).join(known, "act", "left").groupBy("src").agg(F.count(F.lit(1)).alias("n_proposed"), F.count("ok").alias("n_valid"))


@register
def planner_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Up to ten valid distinct acts per source in the order of their first mention."""
    valid = adapters.cites(spark, sf).where("act % 2 = 0").groupBy("src", "act").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(structure.Window.partitionBy("src").orderBy("ord", "act"))
    return valid.withColumn("place", place).where("place <= 10").select("src", "act", "place")


@register
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows merged with updates: an update's values win."""
    stored = table(spark, sf, "customer").where("c_custkey % 5 <> 0 or c_custkey % 3 <> 0").select("c_custkey", col("c_name").alias("old_name"), F.lit("old").alias("old_state"))
    updates = table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", col("c_name").alias("new_name"), F.lit("new").alias("new_state"))
    return stored.join(updates, "c_custkey", "full").select("c_custkey", F.coalesce("new_name", "old_name").alias("name"), F.coalesce("new_state", "old_state").alias("state"))


@register
def ref_parse_external(spark: SparkSession, sf: str) -> DataFrame:
    """References as documents have them: 95/46, 1612/68/EEC, 2016/679, 300/2008."""
    target = "case o_orderkey % 4 when 0 then concat(lpad(o_orderkey % 100, 2, '0'), '/', o_custkey % 1000) when 1 then concat(1000 + o_custkey % 1100, '/', o_orderkey % 100, '/EEC') when 2 then concat(1950 + o_orderkey % 70, '/', o_custkey) else concat(100 + o_custkey % 900, '/', 1990 + o_orderkey % 30) end"
    year, number = refs.external_year_number(col("target"))
    return table(spark, sf, "orders").select("o_orderkey", F.expr(target).alias("target")).select("o_orderkey", year.alias("year"), number.alias("number"))


@register
def query_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    asked = list(search.QUERY_REWRITES)
    pick = F.element_at(F.array(*map(F.lit, [*asked, "data act"])), (col("event_id") % (len(asked) + 1) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", pick.alias("q")).select("event_id", search.rewritten(col("q")).alias("query"))


@register
def oj_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    records = adapters.registry(spark, sf).select(F.substring("celex", 2, 4).alias("year"), F.expr("cast(ord % 50 as string)").alias("number"), "type")
    numbers = table(spark, sf, "orders").select("o_orderkey", F.expr("cast(1980 + o_orderkey % 50 as string)").alias("year"), F.expr("cast(o_custkey % 60 as string)").alias("number"))
    return search.act_types_of(numbers, records)


@register
def xref_extract(spark: SparkSession, sf: str) -> DataFrame:
    said = "concat('See Articles ', o_orderkey % 40, ' to ', o_orderkey % 40 + o_custkey % 9, ', article ', o_custkey % 30, ' and Articles ', o_custkey % 7, ' and ', o_custkey % 7 + 3)"
    found = table(spark, sf, "orders").select("o_orderkey", F.posexplode(refs.article_mentions(F.expr(said))).alias("ord", "m"))
    return found.select("o_orderkey", col("ord").cast("long").alias("ord"), "m.first", "m.last")


@register
def parse_formex(spark: SparkSession, sf: str) -> DataFrame:
    return formex.parsed(adapters.formex_acts(spark, sf)).select("doc_id", "kind", "ordinal", "number", "text")


@register
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Closed days of the request stream, read to its present end."""
    return streams.drained(streams.daily_counts(streams.requests(spark, sf)), "daily")


@register
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drained(streams.rate_limited(streams.requests(spark, sf)), "rate-limit")


@register
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's last request, kept by a stream."""
    asked = streams.requests(spark, sf).select("user_id", "id", "ts")
    return upserts.drained(asked, "upserts", "user_id", ["ts", "id"]).select("user_id", "id")


QUERIES |= library.QUERIES | judgments.QUERIES | flat_laws.QUERIES | proposals.QUERIES | html_laws.QUERIES | crossrefs.QUERIES | grounded.QUERIES | inputs.QUERIES
ORACLE_SQL: dict[str, str] = {k: v for k, v in (SQL | library.SQL | judgments.SQL | flat_laws.SQL | proposals.SQL | html_laws.SQL | crossrefs.SQL | grounded.SQL | inputs.SQL).items() if k in QUERIES}
#: Queries without SQL; their tests compare them with brute force.
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLE_SQL))
