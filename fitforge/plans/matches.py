"""Registered queries on matches of requirements and persons, and the same in DuckDB SQL.

Labels of embeddings stand for persons: their vectors are bullets, but for those of label 7
and more, who have only their first vector; vectors with a key of 1 modulo 10 are requirements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.operators import vectors
from fitforge.plans.postings import _pick, _picked
from fitforge.plans.queries import BASELINE, _query

_SECTIONS = ["required", "nice", "responsibilities"]
_THRESHOLD = BASELINE + 0.3


def _matches(t) -> DataFrame:
    v = t("embeddings")
    requirements = v.where("vec_id % 10 = 1").withColumn("section", _pick(_SECTIONS, F.floor(F.col("vec_id") / 10)))
    own = v.where("vec_id % 10 <> 1")
    nth = F.row_number().over(vectors.Window.partitionBy("label").orderBy("vec_id"))
    # MOST_BULLETS vectors a person at most are gathered
    few = own.withColumn("n", nth).where(F.col("n") <= vectors.MOST_BULLETS)
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    people = few.groupBy(F.col("label").alias("person")).agg(F.when(F.col("person") < 7, gathered).otherwise(F.array().cast("array<array<float>>")).alias("bullets"), F.min_by("embedding", "vec_id").alias("whole"))
    return vectors.best_match_of_each(requirements, people, "vec_id").join(requirements.select("vec_id", "section"), "vec_id")


_MATCHES_SQL = f"""
    own AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 10 <> 1),
    targets AS (SELECT label AS person, embedding FROM own WHERE n <= CASE WHEN label < 7 THEN {vectors.MOST_BULLETS} ELSE 1 END),
    matches AS (
        SELECT person::BIGINT AS person, r.vec_id, {_picked(_SECTIONS, 'r.vec_id // 10')} AS section, max(list_cosine_similarity(r.embedding::DOUBLE[], p.embedding::DOUBLE[])) AS best
        FROM embeddings r, targets p WHERE r.vec_id % 10 = 1 GROUP BY ALL)"""


@_query(f"WITH {_MATCHES_SQL} SELECT person, vec_id, round(best, 6) AS best FROM matches")
def vec2_best_of_bullets_or_whole(t):
    return _matches(t).select("person", "vec_id", F.round("best", 6).alias("best"))


@_query(f"""
    WITH {_MATCHES_SQL}
    SELECT person, vec_id, section, round(best, 3) AS similarity, row_number() OVER (PARTITION BY person ORDER BY round(best, 3), vec_id)::INT AS place
    FROM matches WHERE section <> 'nice' AND best < {_THRESHOLD} QUALIFY place <= 5""")
def vec4_weak_requirements(t):
    return vectors.weak_requirements(_matches(t), _THRESHOLD, ["person"], "vec_id").select("person", "vec_id", "section", "similarity", "place")


@_query(f"""
    WITH {_MATCHES_SQL}, raw AS (SELECT person, section, avg(best) AS raw FROM matches GROUP BY ALL)
    SELECT section, round(avg(raw), 5) AS mean, round(stddev_samp(raw), 5) AS stdev, round(min(raw), 5) AS lowest, round(max(raw), 5) AS highest, count(*) AS n FROM raw GROUP BY section""")
def vec5_raw_scores(t):
    raw = _matches(t).groupBy("person", "section").agg(F.avg("best").alias("raw"))
    return raw.groupBy("section").agg(F.round(F.avg("raw"), 5).alias("mean"), F.round(F.stddev_samp("raw"), 5).alias("stdev"), F.round(F.min("raw"), 5).alias("lowest"), F.round(F.max("raw"), 5).alias("highest"), F.count("*").alias("n"))
