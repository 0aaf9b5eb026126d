"""A keyed table kept by a stream: the last row of every key wins.

Each micro-batch writes the last row of each of its keys to a folder named by its number, over what an earlier try of the same
batch left there, so a batch that is replayed after a failure changes nothing. Reading takes a key's row from its latest batch;
``compacted`` merges the batches so far into one table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.sources.stored import shared_home


def last_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order`` (nulls first; equal rows are interchangeable); rows without a key are left
    out. Rows are reduced before the shuffle, so a hot key is one row a task."""
    whole = F.struct(*rows.columns)
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max_by(whole, F.struct(*order, *(c for c in rows.columns if c not in order))).alias("row"))
    return found.select("row.*")


def write_batch(batch: DataFrame, number: int, path: str, key: str, order: list[str]) -> None:
    last_rows(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")


def current(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The table as of the batches written so far: the row of a key's latest batch."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return last_rows(spark.read.schema(with_batch).parquet(path), key, ["batch"]).drop("batch")


def compacted(spark: SparkSession, path: str, schema: T.StructType, key: str, target: str, number: int = 0) -> None:
    """The table so far as one batch of a new folder."""
    current(spark, path, schema, key).write.mode("overwrite").parquet(f"{target}/batch={number}")


def drained(stream: DataFrame, name: str, key: str, order: list[str]) -> DataFrame:
    """Run ``stream`` over all that is there now and return the table of last rows."""
    spark = stream.sparkSession
    path = f"{shared_home(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda batch, number: write_batch(batch, number, f"{path}/rows", key, order)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{path}/rows", stream.schema, key)
