"""Quality by importance resampling of hashed n-gram models.

Two generative models give each hashed n-gram a probability: one of target text
(documents labelled as good), one of all raw text.  A document's weight is the
ratio of the two for a passage of it, so that long and short documents compare.
Documents are sampled without replacement in proportion to their weights by the
Gumbel top-k trick: the k largest values of log weight plus Gumbel noise, which a
hash of the document makes reproducible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut
from fitforge.llm.textkernel import LOWER, Texts, mix, span_hashes, texts_of, words_of

BUCKETS = 1 << 16
#: Occurrences that each bucket is given under both models, so that rare n-grams say little.
PRIOR = 20.0
SEED = 20_240_101
#: Labelled good documents that the target model counts, at most: those with the smallest hashes of doc_id.
TARGET_ROWS = 50_000
#: How far the log weights of labelled good and bad rows lie apart in the mean.  It sets the length of the passage
#: that a weight speaks of: so many times the mean log ratio of a document's n-grams.  Longer passages let the ratio
#: decide, shorter ones the noise, whose standard deviation is 1.3.
GAP = 12.0
#: The passage where labels do not tell the gap.
PASSAGE = 6.0
#: Bins by which the k-th largest value, or the best one to cut at, is found.
BINS = 4096

_U64 = np.uint64


def _kinds() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint64)
    kind[ord("a") : ord("z") + 1] = kind[0x80:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


_KIND = _kinds()


def ngram_buckets(texts: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and how many each text has.

    Per word: the word, its shape, and both together with those of the word before.
    A shape is the kinds of the first two and last two bytes and whether the word
    is the one before once more.
    """
    words = words_of(texts)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data, last = texts.data, words.ends - 1
    word = span_hashes(LOWER[data], words.starts, words.ends)
    shape = np.zeros(n, np.uint64)
    for at in (words.starts, np.minimum(words.starts + 1, last), np.maximum(last - 1, words.starts), last):
        shape = shape << _U64(8) | _KIND[data[at]]
    opening = np.zeros(n, bool)
    opening[words.bounds[:-1][words.per_text > 0]] = True
    before = np.arange(n) - 1
    again = ~opening & (word[before] == word)
    shape = mix(shape << _U64(1) | again.astype(np.uint64))
    grams = [word, mix(shape + _U64(1))]
    for one, salt in ((word, 2), (shape, 3)):
        grams.append(mix(np.where(opening, _U64(0), one[before]) * _U64(31) + one + _U64(salt)))
    return (np.stack(grams, axis=1).reshape(-1) % _U64(buckets)).astype(np.int64), 4 * words.per_text


def _counts(buckets: int):
    """Rows (bucket, target, raw) of a batch; target counts n-grams of rows marked as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column(0)):
                grams, counts = ngram_buckets(texts, buckets)
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[np.repeat(good[texts.first : texts.first + len(texts)], counts)], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(target[seen]), pa.array(raw[seen])], names=["bucket", "target", "raw"])

    return run


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with ``quality`` of the labels (null without one); several labels of a document: the worst."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.join(known, "doc_id", "left")


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id of ``rows`` documents labelled as good, or of all if they are fewer."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("_place", F.xxhash64("doc_id", F.lit(seed)))
    # so many hashes go on to the sort, whatever the number of labels
    share = min(1.0, 1.2 * rows / max(1, good.count()))
    near = good.where(F.pmod("_place", F.lit(1_000_000)) <= int(share * 1_000_000))
    return near.orderBy(F.pmod("_place", F.lit(1_000_000)), "doc_id").limit(rows).select("doc_id")


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket.

    The raw model counts all documents, the target model at most ``target_rows`` good
    ones; these ids are so few that they are broadcast and no text is shuffled.
    """
    good = target_ids(labels, target_rows).withColumn("good", F.lit(True))
    marked = docs.select("text", "doc_id").join(F.broadcast(good), "doc_id", "left")
    rows = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counts(buckets), "bucket long, target long, raw long")
    # as many rows as there are buckets, however large the corpus
    sums = rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[sums["bucket"]], raw[sums["bucket"]] = sums["target"], sums["raw"]
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + PRIOR) / (expected + PRIOR))


def _weights(doc_id: pa.Array, text: pa.Array, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean log ratio of each row's n-grams, and its Gumbel noise."""
    mean = np.zeros(len(text))
    for texts in texts_of(text):
        grams, counts = ngram_buckets(texts, len(ratio))
        whose = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(whose, ratio[grams], minlength=len(texts))
        mean[texts.first : texts.first + len(texts)] = total / np.maximum(counts, 1)
    key = doc_id.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    uniform = ((mix(key + _U64(seed)) >> _U64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return mean, -np.log(-np.log(uniform))


def mean_ratios(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, mean_ratio (of the n-grams) and noise (Gumbel, by a hash of doc_id) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, noise = _weights(batch.column(0), batch.column(1), ratio, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(noise)], names=["doc_id", "mean_ratio", "noise"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mean_ratio double, noise double")


def passage_length(means: DataFrame, labels: DataFrame) -> float:
    """The length at which labelled good rows weigh GAP more than bad ones; PASSAGE where they do not weigh more."""
    known = _marked(means, labels)
    good, bad = known.agg(F.avg(F.when(F.col("quality") == 1, F.col("mean_ratio"))), F.avg(F.when(F.col("quality") != 1, F.col("mean_ratio")))).first()
    return GAP / (good - bad) if good is not None and bad is not None and good - bad > 1e-9 else PASSAGE


def _binned(weights: DataFrame, column: str) -> tuple[DataFrame, float, float]:
    lo, hi = weights.agg(F.min(column), F.max(column)).first()
    step = ((hi - lo) / BINS or 1.0) if lo is not None else 1.0
    return weights.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col(column) - F.lit(lo or 0.0)) / F.lit(step)))), lo or 0.0, step


def calibrated_floor(weights: DataFrame, labels: DataFrame) -> float:
    """The log weight that separates labelled rows best.

    Of all cuts between bins with the largest sum of the rates of good rows above
    and bad rows below, the middle one.  Without labels of both kinds there is none.
    """
    known = _marked(weights, labels).where("quality is not null").select("quality", "log_weight")
    binned, lo, step = _binned(known, "log_weight")
    found = binned.groupBy("bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")).toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    if len(found):
        good[found["bin"]], bad[found["bin"]] = found["good"], found["bad"]
    if not good.sum() or not bad.sum():
        return -np.inf
    above = good.sum() - np.concatenate(([0], np.cumsum(good)))
    below = np.concatenate(([0], np.cumsum(bad)))
    gain = above / good.sum() + below / bad.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(lo + step * (best[0] + best[-1]) / 2)


def sample_size(weights: DataFrame, labels: DataFrame) -> int:
    """How many rows to sample where the caller does not say: those whose log weight is above :func:`calibrated_floor`."""
    return weights.where(F.col("log_weight") >= F.lit(calibrated_floor(weights, labels))).count()


def kth_largest(weights: DataFrame, k: int) -> float:
    """The k-th largest noisy_weight, narrowed down by bins until a bin has few rows; above all of them for no k."""
    if k <= 0:
        return np.inf
    rows = weights.select("noisy_weight")
    while True:
        binned, _, _ = _binned(rows, "noisy_weight")
        found = dict(binned.groupBy("bin").count().collect())
        at = max(found, default=0)
        for at in sorted(found, reverse=True):
            if k <= found[at]:
                break
            k -= found[at]
        rows = binned.where(F.col("bin") == at).select("noisy_weight")
        if found.get(at, 0) <= 10_000 or len(found) == 1:
            few = rows.orderBy(F.desc("noisy_weight")).limit(min(k, 10_000)).collect()
            return few[-1][0] if few else -np.inf


def _fitted(docs: DataFrame, labels: DataFrame, k: int | None, buckets: int, seed: int) -> tuple[DataFrame, np.ndarray, float, float]:
    """The weights of all rows, the ratio and the passage behind them, and the noisy weight from which on rows stay."""
    ratio = fit_ratio(docs, labels, buckets)
    means = cut(mean_ratios(docs, ratio, seed), "weights")
    passage = passage_length(means, labels)
    log_weight = F.lit(passage) * F.col("mean_ratio")
    weights = means.select("doc_id", log_weight.alias("log_weight"), (log_weight + F.col("noise")).alias("noisy_weight"))
    return weights, ratio, passage, kth_largest(weights, sample_size(weights, labels) if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight, noisy_weight, kept.

    Kept are the k rows with the largest noisy weights, whatever their labels.
    Without ``k`` it is :func:`sample_size`.  Null and empty texts have log weight 0;
    very long ones weigh as much as a passage of them.  Repeated rows have one noise
    and are kept or not together, so that ties at the k-th place all stay; rows
    without doc_id share one noise.  Labels of unknown documents do not count; without
    labels of both kinds all rows stay; an empty table gives no rows.
    """
    weights, _, _, floor = _fitted(docs, labels, k, buckets, seed)
    return weights.withColumn("kept", F.col("noisy_weight") >= F.lit(floor))


def keep_target_like(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns.

    Rows are weighed once more where they are read, which costs less than to shuffle
    their texts; rows without doc_id are judged by their texts as well.  Null, empty and
    very long texts, ties and repeated rows are judged as :func:`resample` says; an empty
    table gives no rows.
    """
    _, ratio, passage, floor = _fitted(docs, labels, k, buckets, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, noise = _weights(batch.column("doc_id"), batch.column("text"), ratio, seed)
            yield batch.filter(pa.array(passage * mean + noise >= floor))

    return docs.mapInArrow(run, docs.schema)
