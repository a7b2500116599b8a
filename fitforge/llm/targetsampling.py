"""Sampling towards a target distribution, by hashed word n-grams, with exact ranks.

Two bags of n-grams, of the target and of all documents, give each hash bucket a gain.
The gains lie in an array, in which a document's features look up theirs; their sum and
Gumbel noise are its score.  The highest scores are drawn.

Scores are ranked by parallel sorting by regular sampling.  Runs are sorted where they
are; rows at regular places of each run give splitters; segments between splitters are
exchanged, and each is merged and numbered by itself.  Counts of the segments before it
turn these numbers into ranks of the whole.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitforge.llm.scratch import cut
from fitforge.llm.textkernel import LOWER, Texts, equal_spans, texts_of

BUCKETS = 10_000
#: Longest run of words that is a feature.
WIDTH = 3
SEED = 42
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: So many of a hundred of the others are.
PERCENT = 5
#: Rows that runs give as samples together, at most.  They set how even segments are, never the ranks.
SAMPLES = 100_000
#: Segments for each task of the exchange: hashing deals several small ones more evenly than one large one.
SEGMENTS_PER_TASK = 8

_IN_WORD = np.isin(np.arange(256), [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
# Fixed value: the polynomial of CRC-32, reflected.
_CRC_POLYNOMIAL = 0xEDB88320
_POWERS = 32


@lru_cache(maxsize=1)
def _zero_bytes() -> np.ndarray:
    """What 2 ** k more zero bytes make of a CRC-32: [k, place of a byte in it, that byte]."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_CRC_POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    values = (np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    steps = [table[values & np.uint32(255)] ^ (values >> np.uint32(8))]
    while len(steps) < _POWERS:
        steps.append(_through(steps[-1], steps[-1]))
    return np.stack(steps)


def _through(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = step[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ step[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings put together, from those of both and the length of the right ones."""
    out, steps = left.copy(), _zero_bytes()
    for k in range(int(length.max(initial=0)).bit_length()):
        longer = (length >> k) & 1 == 1
        out[longer] = _through(steps[k], out[longer])
    return out ^ right


def feature_buckets(texts: Texts, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, whose text each is of, and how many words each text has.

    Words, in texts with A-Z lower-cased, are runs of digits, a-z and all characters
    beyond ASCII.  Features are all runs of 1 to ``width`` of them with one space between.
    """
    data, n = LOWER[texts.data], len(texts.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    n_words = np.diff(np.searchsorted(starts, texts.bounds))
    whose = np.repeat(np.arange(len(texts)), n_words)
    length = ends - starts
    which, values = equal_spans(data[inside[1:-1]], length)
    word = np.array([zlib.crc32(v) for v in values.to_pylist()], np.uint32)[which] if len(which) else np.zeros(0, np.uint32)
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    crc, owner = [word], [whose]
    for k in range(1, min(width, len(word))):
        # runs of k + 1 words begin where runs of k do, but for those that would leave their text
        begins = np.flatnonzero(whose[:-k] == whose[k:])
        run = joined_crc(crc[-1][_places(whose, k, begins)], space, np.broadcast_to(one, len(begins)))
        crc.append(joined_crc(run, word[begins + k], length[begins + k]))
        owner.append(whose[begins])
    return (np.concatenate(crc) % np.uint32(buckets)).astype(np.int64), np.concatenate(owner), n_words


def _places(whose: np.ndarray, k: int, begins: np.ndarray) -> np.ndarray:
    """Where the runs of ``k`` words that begin at ``begins`` stand among all runs of ``k`` words."""
    if k == 1:
        return begins
    return np.searchsorted(np.flatnonzero(whose[: 1 - k] == whose[k - 1 :]), begins)


def feature_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of column ``text`` each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                counts += np.bincount(feature_buckets(texts, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    # as many rows as there are buckets, however many texts there are
    sums = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in sums:
        counts[bucket] = n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log ratio of its smoothed shares, rounded down."""
    all_raw, all_target, buckets = int(raw.sum()), int(target.sum()), len(raw)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_raw + buckets) / ((s + 1.0) * (all_target + buckets))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths from the hash of ``seed:doc_id``; nothing stands for null."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for texts in texts_of(batch.column(1)):
                found, owner, words = feature_buckets(texts, len(gain))
                at = slice(texts.first, texts.first + len(texts))
                n_words[at] = words
                n_features[at] = np.bincount(owner, minlength=len(texts))
                # sums of whole numbers below 2 ** 53 are exact
                weight[at] = np.bincount(owner, gain[found], minlength=len(texts)).astype(np.int64)
            noises = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n_words, n_features, weight, weight + noises))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list[str], rank: str = "rank", segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3 ... by the long columns ``order``, ascending, nulls last.

    Rows that are alike in ``order`` have ranks next to each other, and may lie in
    several segments.  There is no rank twice; an empty table gives no rows.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = segments or SEGMENTS_PER_TASK * tasks
    keys = [F.coalesce(F.col(c), F.lit(2**63 - 1)).alias(f"_k{i}") for i, c in enumerate(order)]
    # sorted where they are and written with their places: these do not change when a task is run again
    place = F.monotonically_increasing_id()
    names = [*(f"_k{i}" for i in range(len(order))), "_place"]
    runs = cut(rows.select("*", *keys).sortWithinPartitions(*names[:-1]).withColumn("_place", place), "runs")
    shift = 33  # the number of the run is above, the place in it below
    lengths = runs.groupBy(F.shiftright("_place", shift).alias("_run")).agg(F.count("*").alias("_length"))
    n_runs = max(1, lengths.count())
    each = max(1, min(segments, samples // n_runs))
    at = F.col("_place").bitwiseAND((1 << shift) - 1)
    step = F.greatest(F.lit(1), F.expr(f"_length div {each}"))
    # every step-th row of its run stands for those up to the next one
    sampled = (
        runs.select(*names, F.shiftright("_place", shift).alias("_run"))
        .join(lengths, "_run")
        .where(F.pmod(at, step) == 0)
        .select(*names, F.least(step, F.col("_length") - at).alias("_for"))
    )
    found = sorted(tuple(r) for r in sampled.collect())
    ends = np.cumsum([r[-1] for r in found])
    cuts = np.unique(np.searchsorted(ends, np.arange(1, segments) * ends[-1] / segments)) if found else []
    splitters = [found[i][:-1] for i in cuts]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the segment: how many splitters are at or below a row."""
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
            segment = np.zeros(batch.num_rows, np.int32)
            turns = np.flatnonzero(np.diff(columns[-1] >> shift)) + 1 if batch.num_rows else []
            # a batch can hold the end of a run and the start of another
            for first, end in pairwise([0, *turns, batch.num_rows]):
                piece = range(first, end)
                own = lambda i: tuple(c[i] for c in columns)
                low, high = (bisect_left(splitters, own(i)) for i in (first, end - 1)) if piece else (0, 0)
                segment[first:end] = low
                for s in splitters[low : high + 1]:
                    segment[first + bisect_left(piece, s, key=own) : end] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], names=[*batch.schema.names, "_segment"])

    exchanged = runs.mapInArrow(dealt, T.StructType([*runs.schema, T.StructField("_segment", T.IntegerType())]))
    # one row per segment
    counts = exchanged.groupBy("_segment").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_segment", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_segment").orderBy(*names)
    return (
        exchanged.withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(before), "_segment")
        .select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(rank))
    )


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the N rows with ``least_words`` words the ``percent * N / 100`` (rounded down) with
    the highest scores are drawn and ranked from 1, ties to the smaller doc_id; others
    have no rank.  Null and empty texts have no features and weight 0, and rows without
    doc_id share one noise and come last among equal scores.  Repeated rows are rows of
    their own with ranks next to each other.  An empty target leaves every bucket its
    smoothed share; an empty table gives no rows.
    """
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    rows = cut(scored(docs, gain, seed), "scores")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count() * percent // 100
    sorted_rows = ranked(rows.where(enough).withColumn("_down", -F.col("score")), ["_down", "doc_id"])
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = sorted_rows.select(*columns, F.when(F.col("rank") <= n, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
