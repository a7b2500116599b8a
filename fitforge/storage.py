"""Tables written to the folder that driver and executors share, and tables of committed snapshots.

A snapshot table is a folder of data that is never changed and of commits that are
numbered from 1.  A commit names the data folders that make up the table; it is written
last, whole and under a number that must be free, so readers see all of a change or
nothing of it, and of two writers one is refused.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one on local masters without the setting, as in tests."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fitforge-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fitforge-{uuid.uuid4().hex}/{name}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: later plans read files, and a lost executor costs a reread."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class ConflictError(RuntimeError):
    """Another writer committed first."""


class SnapshotTable:
    """A table under ``path``, which any file system of Spark's can hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        there = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=0)

    def _commit_of(self, version: int) -> dict:
        if not version:
            return {"folders": [], "done": []}
        stream = self._fs.open(self._at(f"commits/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _move_to(self, version: int, content: dict) -> None:
        """Write the commit under its number, which nobody may have taken: first aside, then by one rename."""
        aside, final = self._at(f"aside/{uuid.uuid4().hex}"), self._at(f"commits/{version:012d}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at("commits"))
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise ConflictError(f"commit {version} of {self.path} is taken")

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a commit, the last one by default; none before the first."""
        folders = self._commit_of(self.version() if version is None else version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def is_done(self, label: str) -> bool:
        return label in self._commit_of(self.version())["done"]

    def append(self, rows: DataFrame, label: str) -> int:
        """Add ``rows`` in one commit and return the version; a label that was committed before changes nothing."""
        return self._change(lambda folders: (folders, rows), label)

    def replace(self, rows: DataFrame, label: str) -> int:
        """Make ``rows`` (which may come from this table) the whole of it, in one commit."""
        return self._change(lambda folders: ([], rows), label)

    def _change(self, change: Callable[[list[str]], tuple[list[str], DataFrame]], label: str) -> int:
        version = self.version()
        before = self._commit_of(version)
        if label in before["done"]:
            return version
        kept, rows = change(before["folders"])
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        self._move_to(version + 1, {"folders": [*kept, folder], "done": [*before["done"], label]})
        return version + 1

    def remove_unreferenced(self, keep: int = 2) -> int:
        """Delete data that none of the last ``keep`` commits names, as failed writers leave it; how many folders went.

        Only while nobody writes or reads an older version."""
        version = self.version()
        named = {f for v in range(max(1, version - keep + 1), version + 1) for f in self._commit_of(v)["folders"]}
        gone = [f for f in self._names("data") if f not in named]
        for f in gone:
            self._fs.delete(self._at(f"data/{f}"), True)
        return len(gone)


def commit_chunks(table: SnapshotTable, chunks: Iterable[tuple[str, DataFrame]], failed: Callable[[str, Exception], None] | None = None) -> int:
    """Append labelled chunks, one commit each, and return how many were committed now.

    Chunks committed by an earlier run are passed over, so a run can be repeated until
    all are in.  A chunk that fails leaves the table as it was; it is reported to
    ``failed`` and the next one follows, or its error is raised.
    """
    committed = 0
    for label, rows in chunks:
        if table.is_done(label):
            continue
        try:
            table.append(rows, label)
            committed += 1
        except ConflictError:
            raise
        except Exception as error:
            if failed is None:
                raise
            failed(label, error)
    return committed


def rewrite_partitions(rows: DataFrame, path: str, partition: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Apply ``change`` to the partitions of the Parquet table at ``path`` that ``touched`` (column ``partition``) names.

    Other partitions are neither read nor written; what a partition becomes is written
    whole before it takes the place of the old one.  A partition that loses all its rows
    is removed.  Returns how many partitions were rewritten.  ``rows`` is the table.
    """
    spark = rows.sparkSession
    # one row per partition: as many as the table has folders
    values = [r[0] for r in touched.select(partition).where(f"{partition} is not null").distinct().collect()]
    if not values:
        return 0
    old = rows.where(rows[partition].isin(values))
    new = written(change(old), "rewritten")
    left = {r[0] for r in new.select(partition).distinct().collect()}
    new.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in set(values) - left:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return len(values)
