"""Registered query on the index of nearest neighbours, and what it must reach in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitforge.operators import neighbours, vectors
from fitforge.plans.queries import _query
from fitforge.storage import new_folder, written

MOST, LEAST_RECALL = 100, 0.9


@_query(f"""
    SELECT b.vec_id AS query_vec_id, least({MOST}, count(*) FILTER (a.label <> b.label)) AS n_found,
           (SELECT count(*) FROM embeddings WHERE len(embedding) > 0) AS n_indexed, true AS recalled
    FROM embeddings b, embeddings a WHERE b.vec_id % 20 = 0 AND len(a.embedding) > 0 GROUP BY b.vec_id""")
def top1_indexed_neighbours(t):
    """Per query: how many neighbours the index gave, how many rows it holds, and whether all queries together found LEAST_RECALL of the true ones."""
    v = t("embeddings")
    queries = v.where("vec_id % 20 = 0")
    index = neighbours.build(v, "vec_id", "label", new_folder(v.sparkSession, "index"))
    probing = neighbours.measured_probing(index, v, queries, MOST)
    found = written(neighbours.search(index, queries, MOST, probing.probes, probing.least), "neighbours")
    true = vectors.nearest_of_each(v, queries, MOST, "vec_id", other="label").select("query_vec_id", "vec_id", F.lit(True).alias("hit"))
    judged = true.join(found.select("query_vec_id", "vec_id", F.lit(True).alias("there")), ["query_vec_id", "vec_id"], "left")
    recall = judged.agg((F.count("there") >= LEAST_RECALL * F.count("hit")).alias("recalled"))
    indexed = index.blocks.agg(F.sum(F.size("keys")).alias("n_indexed"))
    return found.groupBy("query_vec_id").agg(F.count("*").alias("n_found")).join(F.broadcast(indexed), F.lit(True)).join(F.broadcast(recall), F.lit(True))
