"""Operator 10: token-id output as ORC.

Documents are range-partitioned by doc_id and sorted, encoded, and written as ORC: the ids column gets ORC's integer
run-length encoding, every stripe has row indexes (min and max per 10,000 rows), and doc_id has a Bloom filter, so a
reader prunes stripes by metadata and reads stripes in parallel. Each file also keeps the number of its range and the
offset of each document in the range; the start over all documents is that offset plus the sizes of lower ranges,
of which there is one small row per range.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows with equal doc_id lie beside each
other in the order of their texts, each with its own start (rows that are equal in full are interchangeable); an empty
table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.chunks import encode_ids
from lexspark.llm.shared import record_batch, slices, texts_of

SCHEMA = "doc_id long, range_no int, range_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("range_no", pa.int32()), ("range_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("range_no", pa.int32()), ("range_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, stripe_mb: int = 64, range_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs`` to ``path`` in ascending doc_id order; a file gets about ``range_bytes`` of text at most."""

    def encode(batches):
        number, start = TaskContext.get().partitionId(), 0
        for b in slices(batches, 8_000_000):
            flat, stops = encode_ids(texts_of(b), tokenizer_path)
            flat = np.insert(flat.view("<i4"), stops, end_id)
            ends = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(stops), number, np.int32)), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), ids], schema=_ARROW)
            start += int(ends[-1])

    spark = docs.sparkSession
    # Rows of one doc_id and text are told apart by a hash of their other columns, which a repeated task works out alike.
    others = [docs[c] for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (F.xxhash64(*others) if others else F.lit(0).cast("long")).alias("salt"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    # Ranges go by the texts' hashes and those of the rows too, so that many rows of one doc_id, or of none, aren't one range.
    order = ["doc_id", "hash", "salt"]
    (docs.withColumn("hash", F.xxhash64("text"))
     .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(encode, SCHEMA)
     .write.option("orc.stripe.size", stripe_mb << 20).option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.compress", "ZSTD").orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with their start over all documents: doc_id, start, n_tokens, ids."""
    return _with_start(spark.read.schema(SCHEMA).orc(path), spark, path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # One row per range: as many as the write had partitions, whatever the number of documents.
    sizes = spark.read.schema(SCHEMA).orc(path).groupBy("range_no").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "range_no").withColumn("start", F.col("before") + F.col("range_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files."""

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            flat, at = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            n = np.diff(at).astype(np.int64)
            yield record_batch({"doc_id": b.column("doc_id"), "range_no": b.column("range_no"), "range_start": b.column("range_start"), "n_tokens": n, "ids_crc32": crc}, _DIGEST)

    rows = spark.read.schema(SCHEMA).orc(path).mapInArrow(digest, "doc_id long, range_no int, range_start long, n_tokens long, ids_crc32 long")
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
