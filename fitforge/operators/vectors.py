"""Similarity of vectors: filtered top-k, and the best match of each vector among a few.

Vectors are made unit vectors once where they are read, and similarities are matrix
products of Arrow batches.  Vectors of different lengths are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one profile that others are matched against, at most; so they fit in every task.
MOST_BULLETS = 80
#: Vectors of a block where many are searched for at once.
BLOCK = 1_000
#: Tasks that the pairs of one block of queries are dealt over.
SPREAD = 8


def dot(a: str | Column, b: str | Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two columns of a row; 0 where a norm is 0, null where a vector is."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms)


def widths(column: pa.ListArray) -> list[int]:
    """The lengths of the vectors of a list column, ascending; nulls and empty vectors have none."""
    return [w for w in np.unique(column.value_lengths().fill_null(0).to_numpy()).tolist() if w]


def unit_rows(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column and which rows have one: no null, no NaN, of length ``width``; a zero vector stays zero."""
    good = column.value_lengths().fill_null(0).to_numpy() == width
    flat = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(good.sum()), width)
    sound = ~np.isnan(flat).any(axis=1)
    good[np.flatnonzero(good)] = sound
    flat = flat[sound]
    norms = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    return flat / np.where(norms == 0, 1.0, norms)[:, None], good


def _matrices(rows: list) -> dict[int, np.ndarray]:
    """Unit vectors by length."""
    column = pa.array(rows, pa.list_(pa.float64()))
    return {w: unit_rows(column, w)[0] for w in widths(column)}


def with_similarity(rows: DataFrame, targets: dict[int, np.ndarray], name: str) -> DataFrame:
    """``rows`` with the largest similarity of their ``embedding`` to the unit vectors ``targets`` of its length; null without either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(len(batch), np.nan)
            for width, wanted in targets.items():
                if len(wanted):
                    units, good = unit_rows(batch.column("embedding"), width)
                    best[good] = (units @ wanted.T).max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=np.isnan(best))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"{name} double"]))


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str, *filters: Column) -> DataFrame:
    """The k rows most similar to the one row of ``query`` (its ``embedding``), best first.

    Filters come before the limit, so that they never leave it short.  Rows without
    embedding are no candidates; equal similarities go by key.  More than one row of
    ``query`` is an error: see :func:`nearest_of_each`.
    """
    rows = vectors.where(F.col("embedding").isNotNull())
    for f in filters:
        rows = rows.where(f)
    asked = [r[0] for r in query.select("embedding").limit(2).collect()]
    if len(asked) > 1:
        raise ValueError("nearest takes one query row")
    scored = with_similarity(rows, _matrices([a for a in asked if a is not None]), "similarity").where("similarity is not null")
    return scored.orderBy(F.round("similarity", 12).desc(), key).limit(k)


def packed(batch: pa.RecordBatch, size: int) -> Iterator[list[pa.Array]]:
    """The rows (key, other, vector) of a batch as columns of one row each: up to ``size`` keys, their others and unit vectors end to end.

    Vectors of different lengths lie in different rows; rows without a vector in none."""
    for a in range(0, len(batch), size):
        part = batch.slice(a, size)
        for width in widths(part.column(2)):
            units, good = unit_rows(part.column(2), width)
            if good.any():
                keys, others = (part.column(i).filter(pa.array(good)) for i in (0, 1))
                yield [pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([others.to_pylist()], pa.list_(pa.int64())), pa.array([units.tobytes()], pa.binary())]


def blocks(rows: DataFrame, key: str, other: str, size: int = BLOCK) -> DataFrame:
    """Rows of up to ``size`` vectors of one length: their keys, values of ``other``, and unit vectors end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in packed(batch, size):
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "others", "units"])

    cast = rows.where(f"{key} is not null").select(F.col(key).cast("long").alias("key"), F.col(other).cast("long").alias("other"), "embedding")
    return cast.mapInArrow(run, "keys array<long>, others array<long>, units binary")


def best_of_blocks(pairs: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """q, k, o, similarity: the ``k`` best vectors of each query, out of pairs of blocks.

    A pair (keys, others, units of vectors and q_keys, q_others, q_units of queries) is one
    matrix product.  Only vectors with another value of ``others`` than the query's count;
    of each pair, and of pairs of the same queries that follow each other, the k best of
    each query go on, and of these only those with a similarity of ``least`` or more.
    Best are the most similar, then those with the smallest keys.
    """

    def best(found: np.ndarray, keys: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((keys, -found), axis=1)[:, :k]
        return [np.take_along_axis(x, order, axis=1) for x in (found, keys, others)]

    def rows_of(q_keys: np.ndarray, found: np.ndarray, keys: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        there = found > -np.inf
        queries = np.broadcast_to(q_keys[:, None], found.shape)
        return pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (queries, keys, others, found)], names=["q", "k", "o", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, None
        for batch in batches:
            for i in range(len(batch)):
                keys, others, q_keys, q_others = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("keys", "others", "q_keys", "q_others"))
                units, q_units = (np.frombuffer(batch.column(c)[i].as_py()).reshape(n, -1) for c, n in (("units", len(keys)), ("q_units", len(q_keys))))
                if units.shape[1] != q_units.shape[1]:
                    continue
                found = np.round(q_units @ units.T, 12)
                found[q_others[:, None] == others[None, :]] = -np.inf
                if least is not None:
                    found[found < least] = -np.inf
                new = best(found, np.broadcast_to(keys, found.shape), np.broadcast_to(others, found.shape))
                if held is not None and np.array_equal(asked, q_keys):
                    new = best(*(np.concatenate(x, axis=1) for x in zip(held, new, strict=True)))
                elif held is not None:
                    yield rows_of(asked, *held)
                held, asked = new, q_keys
        if held is not None:
            yield rows_of(asked, *held)

    scored = pairs.mapInArrow(run, "q long, k long, o long, similarity double")
    place = Window.partitionBy("q").orderBy(F.desc("similarity"), "k")
    return scored.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, *filters: Column, other: str | None = None, block: int = BLOCK) -> DataFrame:
    """For every row of ``queries`` the k rows of ``vectors`` most similar to it, best first by similarity and key.

    With ``other`` (a column of whole numbers) only rows with another value of it than
    the query's count, and the result is query_``key``, ``key``, ``other`` and similarity:
    blocks of vectors meet blocks of queries, a pair of blocks is one matrix product, and
    only the k best of each query go on.  Any other ``filters`` compare the columns of
    both sides (``query_`` before the names of the queries') pair by pair, before the
    limit.  Rows without embedding take no part.
    """
    if other is None:
        asked = queries.select(*(F.col(c).alias(f"query_{c}") for c in queries.columns))
        pairs = vectors.where(F.col("embedding").isNotNull()).crossJoin(asked)
        for f in filters:
            pairs = pairs.where(f)
        scored = pairs.withColumn("similarity", cosine("embedding", "query_embedding")).drop("embedding", "query_embedding").where("not isnan(similarity)")
        best = Window.partitionBy(f"query_{key}").orderBy(F.desc("similarity"), key)
        return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    pairs = blocks(vectors, key, other, block).crossJoin(blocks(queries, key, other, block).toDF("q_keys", "q_others", "q_units"))
    # the pairs of a block of queries go to SPREAD tasks at most, so that only so many lists of k rows follow for a query
    dealt = [F.xxhash64("q_keys"), F.pmod(F.xxhash64("keys"), F.lit(SPREAD))]
    kept = best_of_blocks(pairs.repartition(*dealt).sortWithinPartitions(*dealt), k)
    return kept.select(F.col("q").alias(f"query_{key}"), F.col("k").alias(key), F.col("o").alias(other), "similarity")


def best_match(rows: DataFrame, bullets: DataFrame, keys: list[str], order: str, most: int = MOST_BULLETS, whole: DataFrame | None = None) -> DataFrame:
    """``keys`` and ``best``, the largest similarity of each row to the first ``most`` bullets by ``order``.

    Without bullets the ``embedding`` of ``whole`` (one row) stands for them; without either best is null.
    """
    few = [r[0] for r in bullets.where("embedding is not null").orderBy(order).limit(most).select("embedding").collect()]
    if not few and whole is not None:
        few = [r[0] for r in whole.where("embedding is not null").limit(1).select("embedding").collect()]
    return with_similarity(rows.select(*keys, "embedding"), _matrices(few), "best").select(*keys, "best")


def best_match_of_each(requirements: DataFrame, people: DataFrame, key: str, most: int = MOST_BULLETS) -> DataFrame:
    """person, ``key`` and best: every requirement against each person's ``bullets``, or ``whole`` without bullets.

    ``people`` has person, bullets (array of vectors; the first ``most`` count) and whole
    (a vector); a person with neither gives no rows.
    """
    kinds = dict(requirements.dtypes)
    targets = people.select("person", F.slice(F.when(F.size("bullets") > 0, F.col("bullets")).otherwise(F.array("whole")), 1, most).alias("targets")).where("get(targets, 0) is not null")
    pairs = blocks(requirements.withColumn("_n", F.lit(0)), key, "_n").crossJoin(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = batch.column("keys")[i].values
                units = np.frombuffer(batch.column("units")[i].as_py()).reshape(len(keys), -1)
                bullets = _matrices(batch.column("targets")[i].as_py()).get(units.shape[1], ())
                if not len(bullets):
                    continue
                best = (units @ bullets.T).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("person")[i].as_py()] * len(keys), pa.int64()), keys, pa.array(best)], names=["person", key, "best"])

    found = pairs.withColumn("person", F.col("person").cast("long")).mapInArrow(run, f"person long, `{key}` long, best double")
    return found.withColumn(key, F.col(key).cast(kinds[key]))


def weak_requirements(matches: DataFrame, threshold: float, group: list[str], order: str, most: int = 5) -> DataFrame:
    """The ``most`` weakest of the matches (best, section) below ``threshold``: similarity rounded to 3 digits, and place.

    Only sections that ask for something count; equal rounded similarities go by ``order``.
    """
    weak = matches.where(F.col("section").isin("required", "responsibilities") & (F.col("best") < threshold)).withColumn("similarity", F.round("best", 3))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("similarity", order))
    return weak.withColumn("place", place).where(F.col("place") <= most).drop("best")


def rescaled(raw: Column, baseline: float) -> Column:
    """(raw - baseline) / (1 - baseline) within 0 and 1; null stays null."""
    scaled = (raw - F.lit(baseline)) / F.lit(1.0 - baseline)
    return F.when(raw.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
