"""Quality rules by an isolation forest over rule statistics.

Trees split a small sample at random values of random statistics until rows stand
alone; rows that few splits isolate are anomalous.  One forest looks at what texts are
made of, one at how much they repeat, as an anomaly of one kind is no anomaly among
statistics of the other.  Forests are grown on a bounded sample; all rows are scored, and
the score at which each forest cuts comes from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut
from fitforge.llm.textkernel import IS_SPACE, Texts, equal_spans, run_numbers, texts_of, word_numbers, words_of

TREES = 100
#: Rows that a tree is grown on; TREES * TREE_ROWS rows are sampled from all documents.
TREE_ROWS = 64
SEED = 7
#: Rates of good labelled rows that the cut of each forest may lose.
MOST_LOST, MOST_LOST_REPEATS = 0.002, 0.001

BINS = 4096
# Fixed values of the contract.
_SYMBOLS = b"#*$%&|<>"
_LEAST_WORDS = 50
_WINDOW = 3

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What texts are made of, and how much of them is said before.
_STATISTICS = ("chars_per_word", "symbols_per_word", "upper_rate", "marks_per_word")
_REPEATS = ("repeat_word_rate", "dup_line_rate")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(sums[bounds])


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[33, *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The counts and the statistics of each text, as columns."""
    data, bounds = texts.data, texts.bounds
    words = words_of(texts)
    n_words = words.per_text
    word_chars = _per_text(~IS_SPACE[data] & ((data & 0xC0) != 0x80), bounds)
    n_symbols = _per_text(_IS_SYMBOL[data], bounds)

    # lines with a word, equal to an earlier one of the text; the lines lie end to end once the breaks are out
    is_break = data == 10
    line_starts = np.unique(np.concatenate((bounds[:-1], np.flatnonzero(is_break) + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    breaks = np.concatenate(([0], np.cumsum(is_break)))
    line = equal_spans(data[~is_break], line_ends - line_starts - (breaks[line_ends] - breaks[line_starts]))[0]
    busy = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    text, line = np.searchsorted(bounds, line_starts[busy], "right") - 1, line[busy]
    n_lines = np.bincount(text, minlength=len(texts))
    order = np.lexsort((line, text))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (text[order][1:] == text[order][:-1])
    n_dup = np.bincount(text[order][again], minlength=len(texts))

    # words in windows of three that come twice or more in the text
    number, _ = word_numbers(data, words)
    window, counts = run_numbers(number, n_words, _WINDOW)
    long = n_words >= _WINDOW
    window, counts = window[np.repeat(long, counts)], np.where(long, counts, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(words.bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(text))
    order = np.lexsort((window, text))
    equal = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(len(number), bool)
    for k in range(_WINDOW):
        covered[first[order[twice]] + k] = True
    n_repeat = _per_text(covered, words.bounds)

    some, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    rates = (
        np.minimum(word_chars / some, 30),
        n_symbols / some,
        _per_text(_IS_UPPER[data], bounds) / chars,
        _per_text(_IS_MARK[data], bounds) / some,
        n_repeat / some,
        n_dup / np.maximum(n_lines, 1),
    )
    return np.stack((n_words, word_chars, n_symbols, n_dup, n_repeat)), np.stack(rates)


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column(1)):
            counts, rates = statistics(texts)
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(r) for r in rates]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), *columns], names=["doc_id", *_COUNTS, *_STATISTICS, *_REPEATS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and the statistics of each row."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in _COUNTS), *(f"{s} double" for s in _STATISTICS + _REPEATS)])
    return docs.select("doc_id", "text").mapInArrow(_statistic_rows, schema)


def _usual_depth(n: int) -> float:
    """Mean depth of a row in a random tree of n rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (statistic or -1, split, left, right, depth at a leaf)."""
    limit = int(np.ceil(np.log2(max(2, len(rows)))))
    nodes: list[list[float]] = []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + _usual_depth(len(part))])
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if depth < limit and len(spread):
            s = int(rng.choice(spread))
            split = rng.uniform(part[:, s].min(), part[:, s].max())
            below = part[:, s] <= split
            nodes[at][:4] = [s, split, grow(part[below], depth + 1), grow(part[~below], depth + 1)]
        return at

    grow(rows, 0)
    return np.array(nodes)


def anomaly_scores(forest: list[np.ndarray], rows: np.ndarray, tree_rows: int) -> np.ndarray:
    """2 ** -(mean path length / usual path length): near 1 for anomalies."""
    total = np.zeros(len(rows))
    for tree in forest:
        at = np.zeros(len(rows), np.int64)
        while True:
            s = tree[at, 0].astype(np.int64)
            going = s >= 0
            if not going.any():
                break
            left = rows[np.arange(len(rows)), np.maximum(s, 0)] <= tree[at, 1]
            at = np.where(going, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return 2.0 ** (-total / max(1, len(forest)) / max(1e-9, _usual_depth(tree_rows)))


def fit_forests(stats: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> list[list[np.ndarray]]:
    """Trees for _STATISTICS and trees for _REPEATS, on a sample of trees * tree_rows rows: those with the smallest hashes of doc_id."""
    near = stats.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(trees * tree_rows).toPandas()
    if not len(near):
        return [[], []]
    out = []
    for columns in (_STATISTICS, _REPEATS):
        sample, rng = near[list(columns)].to_numpy(float), np.random.default_rng(seed)
        out.append([grow_tree(sample[rng.choice(len(sample), min(tree_rows, len(sample)), replace=False)], rng) for _ in range(trees)])
    return out


def _scored(stats: DataFrame, forests: list[list[np.ndarray]], tree_rows: int) -> DataFrame:
    names = ["doc_id", *_COUNTS, "score", "repeat_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for columns, forest in zip((_STATISTICS, _REPEATS), forests, strict=True):
                rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns], axis=1)
                scores.append(pa.array(anomaly_scores(forest, rows, tree_rows)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), *scores], names=names)

    return stats.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in _COUNTS), "score double", "repeat_score double"]))


def calibrated_cut(scored: DataFrame, labels: DataFrame, most_lost: float = MOST_LOST, score: str = "score") -> float:
    """The score above which rows are anomalous.

    Of the cuts that lose at most ``most_lost`` of the good labelled rows, the one
    in the middle of those that catch the most bad ones.  Without labels of both
    kinds nothing is anomalous.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    place = F.least(F.lit(BINS - 1), F.floor(F.col(score) * BINS)).cast("int").alias("bin")
    found = scored.join(known, "doc_id").groupBy(place).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")).toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    if len(found):
        good[found["bin"]], bad[found["bin"]] = found["good"], found["bad"]
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good.sum() - np.concatenate(([0], np.cumsum(good)))
    caught = bad.sum() - np.concatenate(([0], np.cumsum(bad)))
    fine = np.flatnonzero(lost <= most_lost * good.sum())
    best = fine[caught[fine] == caught[fine].max()]
    return float(best[0] + best[-1]) / 2 / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, repeat_score, kept.

    ``base_failed``: under 50 words, or more than half of the words in repeated
    windows of three.  ``kept``: not base_failed, and no anomaly by either forest.  Null
    text has no words; very long texts are measured whole; labels of unknown documents do
    not count; rows without doc_id are judged but not sampled before others, and repeated
    rows alike; an empty table gives no rows.
    """
    stats = cut(rule_statistics(docs), "statistics")
    failed = (F.col("n_words") < _LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    forests = fit_forests(stats.where(F.col("n_words") >= _LEAST_WORDS), trees, tree_rows, seed)
    scored = cut(_scored(stats, forests, tree_rows), "scores")
    fine = F.col("score") <= F.lit(calibrated_cut(scored.where(~failed), labels))
    fresh = F.col("repeat_score") <= F.lit(calibrated_cut(scored.where(~failed), labels, MOST_LOST_REPEATS, "repeat_score"))
    return scored.withColumn("base_failed", failed).select("doc_id", *_COUNTS, "base_failed", "score", "repeat_score", (~F.col("base_failed") & fine & fresh).alias("kept"))
