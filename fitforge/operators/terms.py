"""Terms of texts: document frequencies, dictionary phrases, TF-IDF of two texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_report(docs: DataFrame, group: str, pattern: str, least_groups: int, top: int) -> DataFrame:
    """Terms by the number of groups and documents that have them, the most widespread first."""
    terms = docs.select(group, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("term"))
    # a partial count per (term, group) first, so that a frequent term is no hot key
    per_group = terms.groupBy("term", group).agg(F.count("*").alias("n"))
    report = per_group.groupBy("term").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_docs"))
    return report.where(F.col("n_groups") >= least_groups).orderBy(F.desc("n_groups"), F.desc("n_docs"), "term").limit(top)


#: Phrases that are sent to all tasks, at most; more are joined.
MOST_PHRASES = 200_000


def _counted(phrases: list[str]):
    """Rows (place of the text, phrase, mentions) of a batch; a phrase wins over the shorter ones within it."""
    known = {tuple(p.split(" ")): p for p in phrases}
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for words in sorted(known, key=len, reverse=True):
        by_first.setdefault(words[0], []).append(words)

    def of(text: str) -> Counter:
        words = re.findall("[a-z]+", text.lower())
        found: list[tuple[int, int, str]] = []
        for i, first in enumerate(words):
            found += [(i, i + len(w), known[w]) for w in by_first.get(first, ()) if tuple(words[i : i + len(w)]) == w]
        # from left to right, longer ones first: one that ends within the furthest so far lies in a longer one
        kept, furthest = Counter(), 0
        for _, stop, phrase in sorted(found, key=lambda x: (x[0], -x[1])):
            if stop > furthest:
                kept[phrase] += 1
                furthest = stop
        return kept

    return of


def phrase_mentions(docs: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """``key``, phrase and mentions of the phrases of a dictionary, of any number of words, in texts.

    Words are runs of letters a-z.  A phrase wins over the shorter ones within it.  A
    dictionary of up to MOST_PHRASES is matched where the texts are read, and only
    counts leave the tasks; a larger one is joined.
    """
    listed = [r[0] for r in phrases.select("phrase").where("phrase is not null").distinct().limit(MOST_PHRASES + 1).collect()]
    if len(listed) > MOST_PHRASES:
        return joined_mentions(docs, phrases, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counted(listed)
        for batch in batches:
            rows = [(i, p, n) for i, t in enumerate(batch.column(1).to_pylist()) if t for p, n in of(t).items()]
            place = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=[key, "phrase", "n"])

    source = docs.select(key, "text")
    # several rows may share a key
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, phrase string, n long").groupBy(key, "phrase").agg(F.sum("n").alias("mentions"))


def joined_mentions(docs: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """As :func:`phrase_mentions`, by joins: for dictionaries of any size."""
    words = docs.select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    # looked up by hash; the dictionary is small next to the texts, and Spark broadcasts it where its size allows
    known = phrases.select("phrase").distinct()
    lengths = sorted((r[0] for r in known.select(F.size(F.split("phrase", " "))).distinct().collect()), reverse=True)
    found: list[tuple[int, DataFrame]] = []
    for n in lengths:
        at = words.select(key, F.posexplode("w").alias("i", "one"), "w").where(F.col("i") + n <= F.size("w"))
        here = at.select(key, "i", F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("phrase")).join(known, "phrase").select(key, "i", "phrase")
        for longer, places in found:
            within = places.select(key, F.explode(F.sequence("i", F.col("i") + (longer - n))).alias("i")).distinct()
            here = here.join(within, [key, "i"], "left_anti")
        found.append((n, here))
    every = reduce(DataFrame.unionByName, (x for _, x in found)) if found else words.select(key, F.lit(0).alias("i"), F.lit("").alias("phrase")).limit(0)
    return every.groupBy(key, "phrase").agg(F.count("*").alias("mentions"))


def tfidf_cosine(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key`` and ``similarity`` of two texts by their one- and two-word terms.

    Term frequencies are dampened (1 + ln), terms of one text only weigh 1 + ln 1.5,
    of both 1; a text without terms is like nothing (0).
    """

    def terms(text: str, side: str) -> DataFrame:
        words = pairs.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
        two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return words.select(key, F.explode(F.concat("w", two)).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count("*").cast("double"))).alias(side))

    both = terms(left, "a").join(terms(right, "b"), [key, "term"], "full_outer")
    idf = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(1.0)).otherwise(1.0 + F.log(F.lit(1.5)))
    weighted = both.select(key, (F.coalesce("a", F.lit(0.0)) * idf).alias("a"), (F.coalesce("b", F.lit(0.0)) * idf).alias("b"))
    sums = weighted.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    value = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))).otherwise(0.0)
    return pairs.select(key).join(sums.select(key, value.alias("similarity")), key, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
