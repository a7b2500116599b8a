"""Tables from ruling lines, against brute force over all rectangles."""

import itertools
import random

from fitforge.operators import grids


def _covered(lines, at, a, b):
    """Whether one stretch of lines at a level runs from a to b."""
    upto = None
    for y, x0, x1 in sorted(lines, key=lambda x: x[1]):
        if y == at:
            upto = x1 if upto is None or x0 > upto else max(upto, x1)
            start = x0 if upto == x1 and (upto is None or not any(l[0] == at and l[1] < x0 <= l[2] for l in lines)) else None
            if start is not None:
                begun = start
            if begun <= a and upto >= b:
                return True
    return False


def _brute(across, down):
    """For every corner the smallest rectangle below and to the right whose sides are all covered."""
    corners = {(x, y) for y, x0, x1 in across for x, y0, y1 in down if x0 <= x <= x1 and y0 <= y <= y1}
    out = []
    for x, y in corners:
        for y1, x1 in itertools.product(sorted({c[1] for c in corners if c[1] > y}), sorted({c[0] for c in corners if c[0] > x})):
            if {(x1, y), (x, y1), (x1, y1)} <= corners and all(_covered(across, at, x, x1) for at in (y, y1)) and all(_covered(down, at, y, y1) for at in (x, x1)):
                out.append((x, y, x1, y1))
                break
    return sorted(out)


def test_cells_equal_brute_force():
    r = random.Random(6)
    n = 0
    for _ in range(150):
        lines = [[], []]
        for side in lines:
            for at in range(0, 60, 10):
                for a in range(0, 50, 10):
                    if r.random() < 0.75:
                        side.append((float(at), float(a), float(a + 10)))
        found = grids.cells(*lines)
        assert sorted(found) == _brute(*lines)
        n += len(found)
    assert n > 1000


def test_grids_share_corners():
    two = [(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0), (5.0, 5.0, 6.0, 6.0), (1.0, 1.0, 2.0, 2.0)]
    assert grids.grids(two) == [[two[0], two[1], two[3]], [two[2]]] and grids.grids([]) == []


def test_lines_that_nearly_meet_are_one(spark):
    across = [(0.0, y, 100.0, y + 0.5) for y in (0.0, 20.0, 41.0)] + [(0.0, 2.5, 50.0, 2.5)]
    down = [(x, -2.0, x, 19.0) for x in (0.0, 50.0, 100.0)] + [(x + 1, 21.0, x + 1, 40.0) for x in (0.0, 50.0, 100.0)]
    lines = spark.createDataFrame([(1, *b) for b in across + down] + [(2, *b) for b in across] + [(3, 0.0, 0.0, 2.0, 2.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    spans = [(1, x, y, x + 10, y + 5, t) for x, y, t in ((10.0, 8.0, "a"), (60.0, 8.0, "bc"), (10.0, 28.0, "d"), (60.0, 28.0, "e"), (62.0, 30.0, "f"), (200.0, 8.0, "outside"), (11.0, 9.0, None))] + [(2, 0.0, 0.0, 1.0, 1.0, "x")]
    texts = spark.createDataFrame(spans, "page long, x0 double, y0 double, x1 double, y1 double, text string")
    found = grids.tables(lines, texts)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 2, 2, 4, 4, 6)]
    assert {r["page"]: round(r["table_share"], 6) for r in grids.table_share(found, texts).collect()} == {1: round(6 / 13, 6), 2: 0.0}
