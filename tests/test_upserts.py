"""The keyed table of a stream: last rows, replayed batches, compaction."""

from __future__ import annotations

from lexspark.streaming import upserts

SCHEMA = "key string, at long, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_and_replay(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "b"), (None, 9, "none"), ("c", None, "c")], SCHEMA)
    second = spark.createDataFrame([("a", 0, "late"), ("d", 1, "d"), ("d", 1, "d")], SCHEMA)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):  # each twice, as after a failure
        upserts.write_batch(batch, number, path, "key", ["at"])
    expected = [("a", 0, "late"), ("b", 1, "b"), ("c", None, "c"), ("d", 1, "d")]
    assert rows(upserts.current(spark, path, first.schema, "key")) == expected
    upserts.compacted(spark, path, first.schema, "key", str(tmp_path / "less"))
    assert rows(upserts.current(spark, str(tmp_path / "less"), first.schema, "key")) == expected
    upserts.write_batch(first.limit(0), 2, path, "key", ["at"])
    assert rows(upserts.current(spark, path, first.schema, "key")) == expected


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([("a", k, f"v{k}"), (f"k{k}", k, "own")], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = rows(upserts.drained(stream, "test", "key", ["at"]))
    assert got[1:] == [("k0", 0, "own"), ("k1", 1, "own"), ("k2", 2, "own")] and got[0][0] == "a"
