"""Batches cut in parallel, against a plain loop."""

import random

import pytest

from fitforge.operators import batches


def plain(costs, most_rows, budget):
    out, batch, n, total = [], 0, 0, 0
    for c in costs:
        c = c or 0
        if n and (n >= most_rows or total + c > budget):
            batch, n, total = batch + 1, 0, 0
        out.append(batch)
        n, total = n + 1, total + c
    return out


@pytest.mark.parametrize(("most_rows", "budget", "stretch"), [(1, 10, 1), (3, 10, 3), (5, 20, 7), (7, 1000, 10), (100, 15, 100), (4, 0, 9)])
def test_greedy_batches(spark, most_rows, budget, stretch):
    r = random.Random(most_rows)
    costs = [r.choice([0, 1, 2, 3, 9, 30, None]) for _ in range(143)]
    rows = [(i * 3, c, "x") for i, c in enumerate(costs)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "k long, c long, place_of string").repartition(5)
    found = batches.greedy_batches(table, "k", table["c"], most_rows, budget, stretch).orderBy("k").collect()
    assert [x["batch"] for x in found] == plain(costs, most_rows, budget)
    assert [x["place"] for x in found] == list(range(143)) and {x["place_of"] for x in found} == {"x"}


def test_no_rows_give_no_batches(spark):
    table = spark.createDataFrame([], "k long, c long")
    assert batches.greedy_batches(table, "k", table["c"], 2, 5).count() == 0
    with pytest.raises(ValueError):
        batches.greedy_batches(table, "k", table["c"], 5, 5, 4)
