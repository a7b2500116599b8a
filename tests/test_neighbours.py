"""The index of nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitforge.operators import neighbours

SCHEMA = "vec_id long, label int, embedding array<double>"


def clustered(n=900, width=12, groups=30, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    return [(i, int(i % 4), (centres[i % groups] + 0.4 * r.normal(size=width)).tolist()) for i in range(n)]


def brute(rows, queries, k):
    units = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    labels = {i: x for i, x, _ in rows}
    return {q: [i for _, i in sorted((-round(float(units[q] @ units[i]), 12), i) for i in units if labels[i] != labels[q])[:k]] for q in queries}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered()
    odd = [(None, 0, [1.0] * 12), (5000, 1, None), (5001, 1, []), (5002, 1, [float("nan")] * 12)]
    table = spark.createDataFrame([*rows, *odd], SCHEMA).repartition(5)
    return rows, table, neighbours.build(table, "vec_id", "label", str(tmp_path_factory.mktemp("index")), sample_rows=400)


def test_every_row_is_in_the_index_once(index):
    rows, _, found = index
    keys = [k for r in found.blocks.collect() for k in r["keys"]]
    assert sorted(keys) == [r[0] for r in rows] and 1 < found.n_cells <= 31


def test_all_cells_give_the_true_neighbours(index):
    rows, table, found = index
    queries = [r[0] for r in rows if r[0] % 20 == 0]
    result: dict = {}
    for r in neighbours.search(found, table.where("vec_id % 20 = 0"), 7, found.n_cells).orderBy("query_vec_id", F.desc("similarity"), "vec_id").collect():
        result.setdefault(r["query_vec_id"], []).append(r["vec_id"])
    assert result == brute(rows, queries, 7)


def test_few_cells_reach_the_measured_recall(index):
    rows, table, found = index
    asked = table.where("vec_id % 20 = 0")
    probing = neighbours.measured_probing(found, table, asked, 10, 0.95)
    assert 1 <= probing.probes < found.n_cells and 0 < probing.least < 1
    got = {(r["query_vec_id"], r["vec_id"]) for r in neighbours.search(found, asked, 10, probing.probes, probing.least).collect()}
    true = {(q, i) for q, near in brute(rows, [r[0] for r in rows if r[0] % 20 == 0], 10).items() for i in near}
    assert len(got) == len(true) and len(got & true) >= 0.9 * len(true)


def test_queries_that_one_cell_leaves_short_get_the_rest(index):
    rows, table, found = index
    most = sum(x != 0 for _, x, _ in rows)
    for probes, least in ((1, None), (1, 0.5), (found.n_cells, 2.0)):
        result = neighbours.search(found, table.where("vec_id in (0, 20)"), most, probes, least)
        assert {r["query_vec_id"]: r["count"] for r in result.groupBy("query_vec_id").count().collect()} == {0: most, 20: most}


def test_cells_with_many_rows_lie_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    rows = [(i, i % 2, [1.0, 0.0, 0.0]) for i in range(300)] + [(1000 + i, v, [0.0, 1.0, float(i)]) for i, v in enumerate([0, 1] * 30)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = neighbours.build(table, "vec_id", "label", str(tmp_path / "index"))
    assert found.parts.agg(F.max("parts")).first()[0] >= 7
    result = neighbours.search(found, table.where("vec_id in (0, 1, 1003)"), 5, 1).collect()
    wanted = brute(rows, [0, 1, 1003], 5)
    assert {(r["query_vec_id"], r["vec_id"]) for r in result} == {(q, i) for q, near in wanted.items() for i in near}


def test_no_index_of_nothing_or_of_several_lengths(spark, tmp_path):
    with pytest.raises(ValueError, match="needs vectors"):
        neighbours.build(spark.createDataFrame([(1, 1, None)], SCHEMA), "vec_id", "label", str(tmp_path / "a"))
    with pytest.raises(ValueError, match="3 values"):
        neighbours.build(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0]), (2, 1, [1.0] * 3), (3, 1, [1.0])], SCHEMA), "vec_id", "label", str(tmp_path / "b"))
