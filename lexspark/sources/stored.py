"""Tables written where the driver and all executors can read them, so that what follows doesn't repeat what made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_home(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where everything runs in one process."""
    home, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not home:
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        spark.conf.set("spark.checkpoint.dir", home)
    return home.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new path in the shared folder and read back; a lost executor costs a reading."""
    path = f"{shared_home(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, order: str, folder: str) -> DataFrame:
    """``df`` as an external table in the shared folder, in folders by ``folder`` and buckets by ``key``, as many as shuffles have
    partitions: windows and groups by ``key`` over rows of one folder read that folder alone, and shuffle nothing."""
    spark = df.sparkSession
    own, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format("parquet").partitionBy(folder).bucketBy(n, key).sortBy(key, order)
    writer.option("path", f"{shared_home(spark)}/{own}").saveAsTable(own)
    return spark.table(own)
