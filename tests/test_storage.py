"""Tables of committed snapshots: all of a change or nothing, chunks that fail, partitions that are rewritten."""

import pytest
from pyspark.sql import functions as F

from fitforge import storage

SCHEMA = "k long, chunk int, v string"


@pytest.fixture
def table(spark, tmp_path):
    return storage.SnapshotTable(spark, str(tmp_path / "table"))


def _chunks(spark, broken=None):
    for c in range(5):
        rows = spark.createDataFrame([(c * 10 + i, c, f"v{i}") for i in range(3)], SCHEMA)
        if c == broken:
            # fails in a task, after others have written their part
            rows = rows.withColumn("v", F.when(F.col("k") == c * 10 + 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v"))).repartition(3)
        yield f"chunk {c}", rows


def _keys(table):
    return sorted(r["k"] for r in table.read(SCHEMA).collect())


def test_a_failed_chunk_leaves_the_table_whole(spark, table):
    with pytest.raises(Exception, match="lost"):
        storage.commit_chunks(table, _chunks(spark, broken=2))
    assert table.version() == 2 and _keys(table) == [0, 1, 2, 10, 11, 12]
    # the run is repeated: what is in stays as it is, the rest follows
    assert storage.commit_chunks(table, _chunks(spark)) == 3
    everything = [c * 10 + i for c in range(5) for i in range(3)]
    assert _keys(table) == everything
    assert storage.commit_chunks(table, _chunks(spark)) == 0 and table.version() == 5 and _keys(table) == everything
    # what a writer that died left behind is no part of the table and can go
    spark.createDataFrame([(99, 9, "x")], SCHEMA).write.parquet(f"{table.path}/data/left")
    assert _keys(table) == everything and table.remove_unreferenced() >= 1 and _keys(table) == everything


def test_failures_are_reported_and_others_follow(spark, table):
    failed = []
    assert storage.commit_chunks(table, _chunks(spark, broken=1), lambda label, e: failed.append(label)) == 4
    assert failed == ["chunk 1"] and {k // 10 for k in _keys(table)} == {0, 2, 3, 4}
    assert storage.commit_chunks(table, _chunks(spark)) == 1


def test_readers_see_the_old_or_the_new_table(spark, table):
    storage.commit_chunks(table, _chunks(spark))
    old = table.read(SCHEMA)
    table.replace(table.read(SCHEMA).where("chunk < 2").withColumn("v", F.upper("v")), "upper")
    assert old.count() == 15 and {r["v"] for r in table.read(SCHEMA).collect()} == {"V0", "V1", "V2"}
    assert table.read(SCHEMA, 5).count() == 15 and table.read(SCHEMA, 0).count() == 0


def test_of_two_writers_one_is_refused(spark, table):
    rows = spark.createDataFrame([(1, 0, "a")], SCHEMA)
    other = storage.SnapshotTable(spark, table.path)
    version = table.version
    other.version = lambda: 0  # has looked before the first one committed
    table.append(rows, "first")
    with pytest.raises(storage.ConflictError):
        other.append(rows, "second")
    assert version() == 1 and _keys(table) == [1]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = tmp_path / "parts"
    spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("p")).write.partitionBy("p").parquet(str(path))
    files = lambda: {p: sorted((f.name, f.stat().st_mtime_ns) for f in (path / f"p={p}").glob("*.parquet")) for p in range(10) if (path / f"p={p}").exists()}
    before, rows = files(), spark.read.parquet(str(path))
    gone = spark.createDataFrame([(i,) for i in [3, 13, *range(7, 100, 10)]], "id long")
    touched = rows.join(gone, "id", "left_semi")
    n = storage.rewrite_partitions(rows, str(path), "p", touched, lambda old: old.join(gone, "id", "left_anti"))
    after = files()
    assert n == 2 and {p for p in range(10) if before[p] != after.get(p)} == {3, 7} and 7 not in after
    left = spark.read.parquet(str(path))
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(100) if i % 10 != 7 and i not in (3, 13)]
    assert storage.rewrite_partitions(left, str(path), "p", left.where("id < 0"), lambda old: old) == 0
