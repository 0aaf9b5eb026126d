"""Streaming twins of the usage operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.sources.stored import shared_home


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Requests and addresses per closed day, both exact; late rows beyond the watermark don't count.

    The state has a row per day and address, until the day is closed.
    """
    per_ip = stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "ip").agg(F.count(F.lit(1)).alias("n"))
    per_day = per_ip.groupBy(F.window(F.window_time("window"), "1 day").alias("day")).agg(F.sum("n").alias("n_requests"), F.count("ip").alias("n_ips"))
    return per_day.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n_requests", "n_ips")


def rate_limited(stream: DataFrame, window_seconds: int = 900, most: int = 100) -> DataFrame:
    """The rate limiter with state per client: start of the window and requests in it.

    A client's requests of one micro-batch are held together (time and id only) and folded in the order of time; a request
    that comes with a later micro-batch counts from where the earlier ones ended. The state, two numbers a client, is never
    dropped: a time-out by the clock would keep a run that ends with the input (availableNow) from ending.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat([b[["ts", "id"]] for b in batches]).sort_values(["ts", "id"])
        places = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            if start is None or t - start > window_seconds:
                start, n = t, 0
            n += 1
            places.append(n)
        yield pd.DataFrame({"ip": key[0], "id": rows["id"], "place": places, "allowed": [p <= most for p in places]})
        state.update((start, n))

    return stream.select("ip", "id", "ts").groupBy("ip").applyInPandasWithState(step, "ip string, id long, place long, allowed boolean", "start double, n long", "append", "NoTimeout")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as a stream: id, ts, user_id, ip."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    log = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    return log.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.expr("concat('10.', user_id % 256, '.', event_id % 256, '.0')").alias("ip"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` over all that is there now and return what it wrote.

    Output and checkpoint lie in the shared folder of the cluster, so that a lost executor or driver resumes from there.
    """
    spark = stream.sparkSession
    path = f"{shared_home(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
