"""How filters interact: what each removes in every order, and its Shapley value.

Every document is reduced to the set of filters that it fails.  Per part, the 32
coalitions of filters are tabulated: how many documents, good and toxic ones a
coalition removes.  Any order of filters walks from the empty coalition to the whole
one, so the counts of its steps are differences of two coalitions.

Shapley values come from constrained least squares: of all additive models of the
table, the one that is nearest under the Shapley kernel and right for the whole
coalition.  Its normal equations are solved in rationals, once, for every right-hand
side, so values are exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut
from fitforge.llm.textkernel import Texts, texts_of, word_numbers, words_of

#: The filters, in the order of their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percentages: least share of distinct words, largest share of capitals.
LEAST_DISTINCT = 50
MOST_CAPITALS = 2

_MARKS = np.isin(np.arange(256), list(b"#$%&*|"))
_CAPITALS = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
# UTF-8 bytes that begin a character
_POINTS = (np.arange(256) & 0xC0) != 0x80


def _counted(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked in ``found``."""
    return np.diff(np.concatenate(([0], np.cumsum(found)))[bounds])


def own_failures(texts: Texts) -> np.ndarray:
    """Per text the mask of the filters A to D that it fails; they look at nothing but the text."""
    words = words_of(texts)
    n_words = words.per_text
    distinct = np.zeros(len(texts), np.int64)
    if len(words.starts):
        numbers, values = word_numbers(texts.data, words)
        pairs = np.unique(np.repeat(np.arange(len(texts)), n_words) * len(values) + numbers)
        distinct = np.bincount(pairs // len(values), minlength=len(texts))
    capitals, points, marks = (_counted(kind[texts.data], texts.bounds) for kind in (_CAPITALS, _POINTS, _MARKS))
    failing = (n_words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n_words, 100 * capitals > MOST_CAPITALS * points, marks > 0)
    return sum(fails.astype(np.int32) << k for k, fails in enumerate(failing))


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) become (doc_id, part, digest, mask)."""
    for batch in batches:
        masks, digests = [np.zeros(0, np.int32)], []
        for texts in texts_of(batch.column(2)):
            masks.append(own_failures(texts))
            digests += [sha256(texts.bytes_of(i)).digest() for i in range(len(texts))]
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.concatenate(masks).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, part, mask (bit k: fails the k-th filter), good, toxic.

    Failing: A under 200 words; B fewer distinct words than half of all; C more than 2
    capitals A-Z in 100 code points; D any of ``#$%&*|``; E the text (null as empty, told
    by SHA-256) is that of a row with a smaller doc_id.  A null doc_id is neither smaller
    nor larger than any.  A null part is the empty one.  good and toxic say whether any
    label of the doc_id has quality = 1 or toxic = 1; labels of unknown documents do not
    count.  Repeated rows count each, and fail E only where the first doc_id of their
    text is another.
    """
    read = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), "text")
    rows = cut(read.mapInArrow(_looked_at, "doc_id long, part string, digest binary, mask int"), "looked_at")
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    # smallest doc_id of each text: combined by the reading tasks, so that copies do not meet in one
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # a row is joined by its text and its own doc_id: the copies of a text are spread
    marked = named.join(firsts.withColumn("is_first", F.lit(True)), ["digest", "doc_id"], "left")
    known = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    copied = F.when(F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    found = marked.join(known, "doc_id", "left").select(
        "doc_id", "part", (F.col("mask") + copied).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    return found.unionByName(nameless.select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def coalition_table(failing: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """Per part: n_docs, and arrays by coalition of how many documents, good and toxic ones it removes.

    A coalition, a mask of filters, removes what fails any of them.
    """
    by_mask = failing.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )

    def removed(column: str):
        return F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(c) != 0, F.col(column)).otherwise(0)) for c in range(1 << n)))

    return by_mask.groupBy("part").agg(
        F.sum("n").alias("n_docs"), removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic")
    )


def solved(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """The right-hand sides of a square system after elimination; ``rows`` hold the matrix and any number of them."""
    rows, n = [list(r) for r in rows], len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(n: int = len(FILTERS)) -> list[list[Fraction]]:
    """Weight of each coalition's value in the Shapley value of each filter.

    Least squares over the coalitions between the empty and the whole one,
    ``sum of kernel(S) * (v(S) - v({}) - sum of phi_i in S) ** 2``, where the kernel is
    ``(n - 1) / (binom(n, |S|) * |S| * (n - |S|))``, under the constraint that all phi
    sum to ``v(all) - v({})``.  With its multiplier that is a linear system of n + 1
    equations, solved here with one right-hand side for each coalition's value.
    """
    whole = (1 << n) - 1
    kernel = {s: Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, whole)}
    system = []
    for i in range(n):
        matrix = [sum(w for s, w in kernel.items() if s >> i & s >> j & 1) for j in range(n)]
        right = [kernel.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(1 << n)]
        right[0] = -sum(right)
        system.append([*map(Fraction, matrix), Fraction(1), *right])
    efficient = [Fraction(0)] * (1 << n)
    efficient[0], efficient[whole] = Fraction(-1), Fraction(1)
    system.append([Fraction(1)] * n + [Fraction(0), *efficient])
    return solved(system)[:n]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, by the failures of :func:`failures`.

    Long counts of the part's documents: kept after the step and removed by it;
    redundant (failing the step's filter, removed before) and unique_fails (failing no
    other); good_lost and toxic_lost of the removed ones; shapley: what the filter
    removes, summed over all 120 orders.  Steps that remove nothing have their zeros;
    a table without rows has no parts and gives no rows.
    """
    n, whole = len(FILTERS), (1 << len(FILTERS)) - 1
    orders = math.factorial(n)
    weights = [[w * orders for w in row] for row in shapley_weights(n)]
    if any(w.denominator != 1 for row in weights for w in row):
        raise AssertionError("sums over all orders are whole numbers")
    table = coalition_table(failures(docs, labels, part), n)
    # the same 600 steps for every part
    order = F.explode(F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS))))
    steps = table.withColumn("filter_order", order).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    number = lambda k: F.ascii(F.substring("filter_order", k, F.lit(1))) - ord(FILTERS[0])
    bits = F.transform(F.sequence(F.lit(1), "step"), lambda k: F.pow(F.lit(2), number(k)).cast("int"))
    bit = F.element_at("bits", -1)
    after = F.aggregate("bits", F.lit(0), lambda a, b: a + b)
    walked = steps.withColumn("bits", bits).select("*", bit.alias("bit"), after.alias("after"), (after - bit).alias("before"))

    def value(column: str, coalition):
        return F.col(column)[coalition]

    def step_of(column: str):
        return value(column, F.col("after")) - value(column, F.col("before"))

    weighed = F.array(*(F.array(*(F.lit(int(w)) for w in row)) for row in weights))
    mine = weighed[number(F.col("step"))]
    shapley = F.aggregate(F.zip_with(mine, "removed", lambda w, v: w.cast("long") * v), F.lit(0).cast("long"), lambda a, b: a + b)
    return walked.select(
        "part",
        "filter_order",
        "step",
        (F.col("n_docs") - value("removed", F.col("after"))).alias("kept"),
        step_of("removed").alias("removed"),
        (value("removed", F.col("bit")) - step_of("removed")).alias("redundant"),
        (value("removed", F.lit(whole)) - value("removed", F.lit(whole) - F.col("bit"))).alias("unique_fails"),
        step_of("good").alias("good_lost"),
        step_of("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )
