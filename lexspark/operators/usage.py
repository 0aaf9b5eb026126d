"""Usage reports, rate limits and cache policies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_requests"), F.countDistinct("ip").alias("n_ips"))


def top(requests: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return requests.where("status < 500").groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(limit).select(column, "n")


def recency_islands(requests: DataFrame) -> DataFrame:
    """Runs of requests of a user on the same day: gaps and islands over the order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    day = requests.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    changes = F.when(F.lag("day").over(w) == F.col("day"), 0).otherwise(1)
    island = day.withColumn("change", changes).withColumn("island", F.sum("change").over(w))
    return island.groupBy("user_id", "island", "day").agg(F.count(F.lit(1)).alias("n"))


def retained_days(requests: DataFrame, days: int = 90) -> DataFrame:
    """The last days that have requests; days are few, so ranking them needs no partition."""
    per_day = requests.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.orderBy(F.desc("day")).limit(days)


def evicted(blobs: DataFrame, target: int, by: str = "bucket") -> DataFrame:
    """In each cache partition the oldest blobs until at least ``target`` bytes are freed."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy(by).orderBy("mtime", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blobs.withColumn("freed_before", before).where(F.col("freed_before") < target).select("key", by, "size")


def pruned(entries: DataFrame, keep: int, by: str) -> DataFrame:
    """Entries beyond the ``keep`` most recent of each owner."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("recency"), "key"))
    return entries.withColumn("place", place).where(F.col("place") > keep).select("key", by)


def rate_limited(requests: DataFrame, window_seconds: int = 900, most: int = 100, by: str = "ip") -> DataFrame:
    """Fixed windows that start with the first request of a client: per request its place in the window and whether it is allowed.

    The window's start depends on all earlier windows, so a client's requests are folded in order; only the open window is
    carried from one Arrow batch to the next, however many requests a client has.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, start, n = None, None, 0
        for rows in batches:
            places = []
            for c, t in zip(rows[by], rows["ts"]):
                if start is None or c != client and not (pd.isna(c) and pd.isna(client)) or (t - start).total_seconds() > window_seconds:
                    client, start, n = c, t, 0
                n += 1
                places.append(n)
            yield pd.DataFrame({by: rows[by], "id": rows["id"], "place": places, "allowed": [p <= most for p in places]})

    in_order = requests.select(by, "id", "ts").repartition(by).sortWithinPartitions(by, F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    return in_order.mapInPandas(fold, f"{by} string, id long, place long, allowed boolean")
