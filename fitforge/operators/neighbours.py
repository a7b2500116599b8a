"""An index for nearest neighbours: an inverted file of cells, with measured recall.

Cells are the Voronoi cells of centroids that are fitted on a bounded sample; every row
of the table lies in the cell of its nearest centroid.  The index is a table partitioned
by cell, whose rows are blocks of vectors.  A query looks into the cells nearest to it,
as many as a bounded number of queries needed to find their true neighbours; joins by
cell bring its block of queries to the blocks of the cell, and only the best go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.operators import vectors
from fitforge.storage import written

#: Rows that centroids are fitted on, at most: those with the smallest hashes of their keys.
SAMPLE_ROWS = 20_000
#: Cells, at most; fewer in small tables, about the square root of their rows.
MOST_CELLS = 1_024
ROUNDS = 8
#: Rows of a cell that one task holds; larger cells are dealt over several.
PART_ROWS = 50_000
#: Queries that are searched for exactly to see how many cells are needed, at most, and the recall that they must reach.
PROBE_QUERIES = 200
RECALL = 0.95
SEED = 7


@dataclass(frozen=True)
class Index:
    """``blocks``: cell, part, keys, others and units of every row that has a vector; ``parts``: in how many parts each cell lies."""

    blocks: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    key: str
    other: str

    @property
    def n_cells(self) -> int:
        return len(self.centroids)


def _sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` rows with the smallest hashes of their keys, or all if they are fewer."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1_000_000))
    share = min(1.0, 1.2 * most / max(1, rows.count()))
    return rows.where(place <= int(share * 1_000_000)).orderBy(place, key).limit(most)


def fitted_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means over unit vectors; a cell that loses all its rows takes the row that fits worst."""
    centroids = sample[np.random.default_rng(SEED).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        similarity = sample @ centroids.T
        cell = similarity.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(similarity.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        centroids = np.where(norms[:, None] > 0, sums / np.where(norms == 0, 1.0, norms)[:, None], centroids)
    return centroids


def _assigned(rows: DataFrame, key: str, other: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, other, embedding and each of the ``probes`` nearest cells (with nth, from 0) of rows with a vector as long as the centroids'."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = vectors.unit_rows(batch.column(2), width)
            near = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]
            which = np.repeat(np.flatnonzero(good), near.shape[1])
            nth = np.tile(np.arange(near.shape[1]), len(units))
            again = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel().astype(np.int32)), pa.array(nth.astype(np.int32))], names=["key", "other", "embedding", "cell", "nth"])

    cast = rows.where(f"{key} is not null").select(F.col(key).cast("long").alias("key"), F.col(other).cast("long").alias("other"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cast.mapInArrow(run, "key long, other long, embedding array<double>, cell int, nth int")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, other, embedding, cell, part), which lie together by cell and part, as blocks of one cell and part each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in (3, 4)], axis=1)
            turns = np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1 if len(batch) else []
            for a, b in zip([0, *turns], [*turns, len(batch)], strict=True):
                for columns in vectors.packed(batch.slice(a, b - a), size):
                    yield pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int32()) for x in place[a]), *columns], names=["cell", "part", "keys", "others", "units"])

    return rows.select("key", "other", "embedding", "cell", "part").mapInArrow(run, "cell int, part int, keys array<long>, others array<long>, units binary")


def build(rows: DataFrame, key: str, other: str, path: str, sample_rows: int = SAMPLE_ROWS, most_cells: int = MOST_CELLS) -> Index:
    """Index all ``rows`` by their ``embedding`` under the folder ``path``, which all executors see.

    Every row with a key and a vector is in the index once; vectors of another length than
    most of the sample's have no cell and are refused.  A cell with more than PART_ROWS
    rows is dealt over parts, so that none grows with its neighbours.
    """
    named = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col(key).isNotNull())
    sample = [r[0] for r in _sampled(named, key, sample_rows).select("embedding").collect()]
    column = pa.array(sample, pa.list_(pa.float64()))
    found = vectors.widths(column)
    if not found:
        raise ValueError("an index needs vectors")
    lengths = column.value_lengths().to_numpy()
    width = max(found, key=lambda w: ((lengths == w).sum(), w))
    if named.where(F.size("embedding") != width).limit(1).count():
        raise ValueError(f"all vectors must have {width} values")
    units = vectors.unit_rows(column, width)[0]
    cells = max(1, min(most_cells, len(units), round(named.count() ** 0.5)))
    centroids = fitted_centroids(units, cells)
    spark = rows.sparkSession
    _assigned(named, key, other, centroids, 1).write.mode("overwrite").parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    # one row a cell
    parts = assigned.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    dealt = assigned.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    together = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "key")
    _packed(together, vectors.BLOCK).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    return Index(spark.read.parquet(f"{path}/blocks"), parts, centroids, key, other)


def search(index: Index, queries: DataFrame, k: int, probes: int, least: float | None = None) -> DataFrame:
    """query_key, key, other, similarity: the ``k`` best rows of each query in its ``probes`` nearest cells.

    Rows with the query's value of ``other`` do not count, and are left out before the
    limit.  Rows less similar than ``least`` stay behind where they are found, so that
    cells do not send k rows each.  Queries that find fewer than k rows are searched for
    in all cells and without that bound, so that neither leaves one short; queries without
    a vector find nothing.
    """
    found = _searched(index, queries, k, min(probes, index.n_cells), least)
    if probes < index.n_cells or least is not None:
        found = written(found, "found")
        enough = found.groupBy("q").count().where(F.col("count") >= k)
        short = queries.join(enough, F.col(index.key).cast("long") == enough["q"], "left_anti")
        if short.limit(1).count():
            rest = _searched(index, short, k, index.n_cells)
            found = found.join(enough, "q", "left_semi").unionByName(rest)
    return found.select(F.col("q").alias(f"query_{index.key}"), F.col("k").alias(index.key), F.col("o").alias(index.other), "similarity")


def _searched(index: Index, queries: DataFrame, k: int, probes: int, least: float | None = None) -> DataFrame:
    near = _assigned(queries, index.key, index.other, index.centroids, probes)
    # a query goes to each part of its cells, a block of queries to each block of a part
    asked = near.join(F.broadcast(index.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = _packed(asked.repartition("cell", "part").sortWithinPartitions("cell", "part", "key"), vectors.BLOCK)
    pairs = index.blocks.join(asked.toDF("cell", "part", "q_keys", "q_others", "q_units"), ["cell", "part"])
    return vectors.best_of_blocks(pairs, k, least)


@dataclass(frozen=True)
class Probing:
    """How to search: cells for each query, and the similarity below which rows are not worth sending on."""

    probes: int
    least: float | None


def measured_probing(index: Index, rows: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, most_queries: int = PROBE_QUERIES) -> Probing:
    """The least number of cells in which at most ``most_queries`` of the queries find ``recall`` of their true neighbours, and the similarity of the farthest of these.

    These few are searched for exactly among all ``rows``; then it is known in which cells
    their neighbours lie, and the how-many-th cell of the query each is.  If one of them has
    fewer than k neighbours, similarity sets no bound.
    """
    few = _sampled(queries.where(F.col("embedding").isNotNull()), index.key, most_queries)
    true = written(vectors.nearest_of_each(rows, few, k, index.key, other=index.other), "true")
    cells = _assigned(rows.join(true.select(F.col(index.key).alias("_k")).distinct(), F.col(index.key) == F.col("_k"), "left_semi"), index.key, index.other, index.centroids, 1)
    order = _assigned(few, index.key, index.other, index.centroids, index.n_cells)
    placed = true.join(cells.select(F.col("key").alias(index.key), "cell"), index.key)
    placed = placed.join(order.select(F.col("key").alias(f"query_{index.key}"), "cell", "nth"), [f"query_{index.key}", "cell"])
    # as many rows as there are cells
    counts = dict(placed.groupBy("nth").count().collect())
    each = true.groupBy(f"query_{index.key}").agg(F.count("*").alias("n"), F.min("similarity").alias("last"))
    fewest, last = each.agg(F.min("n"), F.min("last")).first()
    least = last if fewest is not None and fewest >= k else None
    reached, total = 0, sum(counts.values())
    for nth in range(index.n_cells):
        reached += counts.get(nth, 0)
        if reached >= recall * total:
            return Probing(nth + 1, least)
    return Probing(index.n_cells, least)
