"""Graph-pattern queries over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def related(edges: DataFrame, act: int, kind: str, limit: int) -> DataFrame:
    """Laws with an edge of a kind to an act, by date."""
    return edges.where((F.col("act") == act) & (F.col("kind") == kind)).select("law", "date", "ord").distinct().orderBy(F.asc_nulls_first("date"), "law", "ord").limit(limit)


def cases(edges: DataFrame, laws: DataFrame) -> DataFrame:
    """Interpreting edges of two hops: case to act to the act's own record."""
    return edges.where("kind = 'interprets'").join(laws, edges.act == laws.ord_key).groupBy("celex").agg(F.countDistinct("law").alias("n_cases"), F.max("date").alias("latest"))


def metadata(laws: DataFrame, edges: DataFrame) -> DataFrame:
    """A law's record with its optional dates: first and last amendment, and how many."""
    dates = edges.where("kind = 'amends'").groupBy("act").agg(F.min("date").alias("first_amended"), F.max("date").alias("last_amended"), F.countDistinct("date").alias("n_dates"))
    return laws.join(dates, laws.ord_key == dates.act, "left").select("celex", "ord_key", "first_amended", "last_amended", F.coalesce("n_dates", F.lit(0)).alias("n_dates"))
