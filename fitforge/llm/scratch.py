"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent (local tests) a temporary folder is made; on a
    cluster that would be invisible to the executors, so it is refused there.
    """
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fitforge-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark drop a query's shuffle files as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    Later stages then read files instead of repeating work, and a lost executor
    costs a reread at most.  The shuffle files behind the table are of no more use
    and go once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fitforge-{uuid.uuid4().hex}/{name}"
    with _without_old_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._fitforge_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote.

    Only for tables that no later plan reads: what was made from them must have been
    written itself.  The tables behind an operator's result stay until the shared
    folder is cleared.
    """
    for table in tables:
        path = getattr(table, "_fitforge_path", None)
        if path:
            there = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(there, True)
