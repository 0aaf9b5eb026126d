"""Term weights, full-text search and the linking of recitals to articles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import STOPWORDS_EN, tokens

# A term of more than one in so many documents counts as frequent.
OFTEN = 1000
# Fixed values of the linking.
BETA, GAMMA, FLOOR, SECOND, MOST_ARTICLES = 0.9, 2, 0.15, 0.75, 2


def terms(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, term) for every token."""
    return docs.select(*key, F.explode(tokens(F.col(text))).alias("term"))


def dealt(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``docs`` dealt by key, so that the counts of a document's terms need its text sent on once and none of its pairs with terms;
    into many parts, as a part's pairs are counted in memory."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return docs.select(*key, text).repartition(parts, *key)


def tf(docs: DataFrame, key: list[str]) -> DataFrame:
    return terms(docs, key).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(frequencies: DataFrame, n_docs: DataFrame, by: list[str] = []) -> DataFrame:
    """log10(N / documents with the term); N counts empty documents too."""
    df = frequencies.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(n_docs, by) if by else df.join(F.broadcast(n_docs))  # n_docs is one row
    return joined.select(*by, "term", "df", F.log10(F.col("n") / F.col("df")).alias("idf"))


def weighted(docs: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf times idf). Terms of more than a thousandth of the documents, which are at most a thousand times a document's
    different terms on average, are broadcast; only the pairs of the others meet their idf in a shuffle."""
    f, n = tf(dealt(docs, key), key), docs.agg(F.count(F.lit(1)).alias("n"))
    i = idf(f, n)
    often = F.broadcast(i.join(F.broadcast(n)).where(OFTEN * F.col("df") > F.col("n")).select("term", "idf"))
    rare = f.join(often, "term", "left_anti").join(i, "term")
    return f.join(often, "term").unionByName(rare, allowMissingColumns=True).select(*key, "term", (F.col("tf") * F.col("idf")).alias("w"))


def magnitudes(weights: DataFrame, key: list[str]) -> DataFrame:
    return weights.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("magnitude"))


def usable_tokens(query: str) -> list[str]:
    cleaned = re.sub(r"[^\w\s\u00c0-\u024f]", " ", query.lower(), flags=re.ASCII)
    return [t for t in cleaned.split() if len(t) > 2 and t not in STOPWORDS_EN]


def content_search(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """All documents (key, text, title) with a score over 0.5, best first: 100 times the cosine with the query's weights, plus
    200 if the query is the document's key and 50 if its title holds the query.

    A query without usable tokens falls back to documents that contain it, with score 1."""
    asked = usable_tokens(query)
    if not asked:
        return substring_fallback(docs, query, key)
    own, n = dealt(docs, [key]), docs.agg(F.count(F.lit(1)).alias("n"))
    # The query is a few literals; only documents that share a term with it need their length, and they alone give its own.
    times = F.create_map(*(F.lit(x) for t in sorted(set(asked)) for x in (t, asked.count(t))))
    qw = F.coalesce(times[F.col("term")], F.lit(0)) * F.col("idf")
    shares = F.arrays_overlap(tokens(F.col("text")), F.array(*map(F.lit, asked)))
    norm = idf(tf(dealt(docs.where(shares), [key]), [key]).where(F.col("term").isin(asked)), n).agg(F.sqrt(F.sum(qw * qw)).alias("q_norm"))  # one row
    near = own.withColumn("near", F.max(shares).over(Window.partitionBy(key))).where("near")
    weights = tf(near, [key]).join(idf(tf(own, [key]), n), "term").select(key, qw.alias("qw"), (F.col("tf") * F.col("idf")).alias("w"))
    parts = weights.groupBy(key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("magnitude"))
    cosine = parts.join(F.broadcast(norm)).select(key, F.when((F.col("magnitude") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("magnitude") * F.col("q_norm"))).otherwise(0.0).alias("cosine"))
    bonus = F.when(F.col(key).cast("string") == query.lower(), 200.0).otherwise(0.0) + F.when(F.lower("title").contains(query.lower()), 50.0).otherwise(0.0)
    scored = docs.select(key, bonus.alias("bonus")).join(cosine, key, "left").select(key, F.round(100 * F.coalesce("cosine", F.lit(0.0)) + F.col("bonus"), 6).alias("score"))
    return scored.where("score > 0.5").orderBy(F.desc("score"), key)


def substring_fallback(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    return docs.where(F.lower("text").contains(query.lower())).select(key, F.lit(1.0).alias("score"))


def unit_terms(units: DataFrame) -> DataFrame:
    """doc_id, kind, ord, term, tf, idf, and n_a and n_r, how many articles and recitals the document has, of each term of a unit
    that its document's articles have; they alone give the idf.

    The units are dealt by document once; all that follows is keyed by it and needs no further shuffle.
    """
    in_doc, is_article = Window.partitionBy("doc_id"), F.col("kind") == "article"
    own = units.where("doc_id is not null and kind in ('article', 'recital')").select("doc_id", "kind", "ord", "text").repartition("doc_id")
    counted = own.withColumns({"n_a": F.count_if(is_article).over(in_doc), "n_r": F.count_if(~is_article).over(in_doc)})
    frequencies = tf(counted, ["doc_id", "kind", "ord", "n_a", "n_r"])
    told = frequencies.withColumn("df", F.count_if(is_article).over(Window.partitionBy("doc_id", "term"))).where("df > 0")
    return told.select("doc_id", "kind", "ord", "n_a", "n_r", "term", "tf", F.log10(F.col("n_a") / F.col("df")).alias("idf"))


def recital_scores(units: DataFrame) -> DataFrame:
    """(doc_id, recital, article, raw cosine, score with the positional prior) of pairs that share a term.

    Articles alone give the idf. Pairs come from the units that share a term within a document, not from a product.
    """
    of_unit = Window.partitionBy("doc_id", "kind", "ord")
    weights = unit_terms(units).withColumn("w", F.col("tf") * F.col("idf")).withColumn("m", F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_unit)))
    side = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "w", "m"))).alias(kind)
    shared = weights.groupBy("doc_id", "n_a", "n_r", "term").agg(side("recital"), side("article"))
    pairs = shared.withColumn("r", F.explode("recital")).withColumn("a", F.explode("article"))
    of_pair = ["doc_id", "n_a", "n_r", F.col("r.ord").alias("recital"), F.col("a.ord").alias("article"), F.col("r.m").alias("m_recital"), F.col("a.m").alias("m_article")]
    joined = pairs.groupBy(*of_pair).agg(F.sum(F.col("r.w") * F.col("a.w")).alias("dot"))
    raw = F.round(F.when((F.col("m_recital") > 0) & (F.col("m_article") > 0), F.col("dot") / (F.col("m_recital") * F.col("m_article"))).otherwise(0.0), 9)
    r_pos, a_pos = (F.col("recital") - 1) / F.greatest(F.col("n_r") - 1, F.lit(1)), (F.col("article") - 1) / F.greatest(F.col("n_a") - 1, F.lit(1))
    prior = F.pow(1 - BETA * F.abs(r_pos - a_pos), F.lit(GAMMA))
    return joined.select("doc_id", "recital", "article", raw.alias("raw"), prior.alias("prior")).select("doc_id", "recital", "article", "raw", F.round(F.col("raw") * F.col("prior"), 9).alias("score"))


def recital_links(units: DataFrame) -> DataFrame:
    """Up to two articles per recital with at least 0.75 of the best score, if a raw cosine reaches 0.15."""
    w = Window.partitionBy("doc_id", "recital")
    ranked = recital_scores(units).withColumns({"best": F.max("score").over(w), "best_raw": F.max("raw").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "article"))})
    return ranked.where((F.col("best_raw") >= FLOOR) & (F.col("best") > 0) & (F.col("score") >= SECOND * F.col("best")) & (F.col("place") <= MOST_ARTICLES)).select("doc_id", "recital", "article", F.round("score", 6).alias("score"))


def recital_orphans(units: DataFrame) -> DataFrame:
    linked = recital_links(units).select("doc_id", F.col("recital").alias("ord")).distinct()
    return units.where("kind = 'recital'").join(linked, ["doc_id", "ord"], "left_anti").select("doc_id", F.col("ord").alias("recital"))


def recital_keywords(units: DataFrame, most: int = 3) -> DataFrame:
    """The terms of a recital with the highest idf over its document's articles."""
    own = unit_terms(units).where("kind = 'recital'")
    place = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy(F.desc("idf"), "term"))
    return own.withColumn("place", place).where(F.col("place") <= most).select("doc_id", F.col("ord").alias("recital"), "place", "term")
