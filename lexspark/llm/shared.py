"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: While it is set, Spark deletes a query's shuffles when the query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows of the table of marks that ``split_by_keys`` broadcasts.
MARKS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexspark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    It cuts the lineage: after an executor is lost only the reading is repeated. Rows of megabytes need few ``rows_a_file``, as
    a writer keeps what it has of a file, and a reader thousands of rows of one, in memory. The shuffles of the writing go
    when it ends: else they stay on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned; nothing may read them from here on."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def split_by_keys(rows: DataFrame, of: list, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose values ``of`` may be a row of ``keys``, and those where they are none for certain.

    ``keys`` becomes a table of at most ``MARKS`` numbers of 64 bits, which is broadcast whatever the number of keys: only
    the first part needs to meet ``keys`` in a shuffle. With 64 bits a number, few others get into it.
    """
    word = lambda *c: F.pmod(F.shiftright(F.xxhash64(*c), 6), F.lit(MARKS))
    bit = lambda *c: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(*c).bitwiseAND(F.lit(63)).cast("int"))
    marks = keys.groupBy(word(*keys.columns).alias("marked_word")).agg(F.bit_or(bit(*keys.columns)).alias("marked_bits"))
    met = rows.join(F.broadcast(marks), word(*of) == F.col("marked_word"), "left")
    perhaps = F.coalesce(F.col("marked_bits").bitwiseAND(bit(*of)), F.lit(0)) != 0
    return met.where(perhaps).select(*rows.columns), met.where(~perhaps).select(*rows.columns)


def least_hashes(df: DataFrame, key, bound: int, n: int) -> DataFrame:
    """At most ``bound`` of the ``n`` rows of ``df``: those with the least hashes of ``key``.

    Rows are first cut at a hash that lets slightly more than ``bound`` through, so only about that many are ordered.
    """
    share = (bound + 8 * bound**0.5 + 8) / max(n, 1)
    few = df if share >= 1 else df.where(F.xxhash64(key) < int(-(2**63) + share * 2**64))
    return few.orderBy(F.xxhash64(key), *(c for c, kind in df.dtypes if not kind.startswith("map"))).limit(bound)


#: What this Python worker keeps from one task to the next, by operator.
WORKER_CACHES: list[dict] = []


def forget_others(own: dict | None = None) -> None:
    """Empty the caches of operators that ran in this worker before; ``own`` stays."""
    for kept in WORKER_CACHES:
        if kept is not own and kept:
            kept.clear()


def slices(batches, most_bytes: int = 4_000_000, column: str = "text"):
    """Cut Arrow batches so that the text column of each slice holds about ``most_bytes`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, most_bytes // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def single_threaded_tokenizers() -> None:
    """Each Spark task uses its own core; the tokenizers library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
