"""Domain tables derived from the general tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over four tasks a core: few bytes of a table, which are one or two partitions, may stand for long work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Act records: ord, celex, title, type, date, eli."""
    year = F.expr("cast(1990 + p_size % 35 as string)")
    mark = F.expr("case p_partkey % 3 when 0 then 'R' when 1 then 'L' else 'D' end")
    number = F.expr("cast(p_partkey % 10000 as string)")
    kind = F.expr("case p_partkey % 3 when 0 then 'regulation' when 1 then 'directive' else 'decision' end")
    short = F.expr("case p_partkey % 3 when 0 then 'reg' when 1 then 'dir' else 'dec' end")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("3"), year, mark, F.lpad(number, 4, "0")).alias("celex"), F.col("p_name").alias("title"), kind.alias("type"),
        F.concat(year, F.lit("-"), F.lpad(F.expr("cast(1 + p_size % 12 as string)"), 2, "0"), F.lit("-01")).alias("date"),
        F.concat(F.lit("http://data.europa.eu/eli/"), short, F.lit("/"), year, F.lit("/"), number, F.lit("/oj")).alias("eli"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: the first half are recitals, the second articles; ord from 1 within each kind."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    n = F.size("lines")
    one = lines.select("doc_id", "lang", n.alias("n"), F.posexplode("lines").alias("pos", "text"))
    half = F.expr("n div 2")
    return one.select("doc_id", "lang", F.when(F.col("pos") < half, "recital").otherwise("article").alias("kind"), (F.when(F.col("pos") < half, F.col("pos")).otherwise(F.col("pos") - half) + 1).alias("ord"), (F.col("pos") + 1).alias("pos"), "text")


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long citations, one per line item."""
    text = F.expr("concat('Article ', l_linenumber, '(', cast(l_quantity as int), ')(a) of Regulation (EU) ', 1990 + l_suppkey % 35, '/', l_partkey)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("act"), text.alias("citation"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: id, ts, ip, route, status, celex, q."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('10.', user_id % 256, '.', event_id % 256, '.7')").alias("ip"),
        F.concat(F.lit("/api/"), "event_type").alias("route"), F.expr("case when event_id % 10 = 0 then 500 else 200 end").alias("status"),
        F.expr("concat('q', user_id % 40)").alias("q"), "user_id",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges: law, act, kind, date."""
    kind = F.expr("case l_returnflag when 'A' then 'amends' when 'N' then 'implements' else 'interprets' end")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("law"), F.col("l_partkey").alias("act"), kind.alias("kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_linenumber").alias("ord"))


def formex_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a Formex act: the first half of its lines are recitals, the second articles."""
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for mark, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(mark), F.lit(written))
    recital = "'<CONSID><NP><NO.P>(' || (i + 1) || ')</NO.P><TXT>' || x || '</TXT></NP></CONSID>'"
    article = "'<ARTICLE><TI.ART>Article ' || (i + 1) || '</TI.ART><PARAG><ALINEA>' || x || '</ALINEA></PARAG></ARTICLE>'"
    parts = lambda of, plan: f"array_join(transform({of}, (x, i) -> {plan}), '')"
    xml = f"""'<ACT><PREAMBLE><GR.CONSID>' || {parts("slice(lines, 1, size(lines) div 2)", recital)} || '</GR.CONSID></PREAMBLE><ENACTING.TERMS>'
     || {parts("slice(lines, size(lines) div 2 + 1, size(lines))", article)} || '</ENACTING.TERMS></ACT>'"""
    return table(spark, sf_dir, "documents").select("doc_id", F.split(clean, "\n").alias("lines")).select("doc_id", F.expr(xml).alias("xml"))
