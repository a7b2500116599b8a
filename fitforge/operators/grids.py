"""Tables that ruling lines make on a page: cells, grids of them, and the text inside.

Lines that nearly coincide are one; where a horizontal and a vertical one meet is a
corner.  A cell is the smallest rectangle to the right of and below a corner whose four
sides lie on lines; cells that share a corner make a grid.  One exchange brings the lines
and the spans of a page together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitforge.operators import pages

# How far lines may miss each other, rows and columns of a table at least, and cells with text.
NEAR, LEAST_SIDE, LEAST_FILLED = 3.0, 2, 4

Line = tuple[float, float, float]  # where it lies, and from where to where it goes


def _levels(values: list[float]) -> dict[float, float]:
    """Values that follow each other by NEAR at most become their mean."""
    groups: list[list[float]] = []
    for v in sorted(set(values)):
        if groups and v - groups[-1][-1] <= NEAR:
            groups[-1].append(v)
        else:
            groups.append([v])
    return {v: sum(g) / len(g) for g in groups for v in g}


def _merged(lines: list[Line]) -> list[Line]:
    """Lines on one level that touch, or miss each other by NEAR at most, are one."""
    level, out = _levels([x[0] for x in lines]), []
    for at, a, b in sorted((level[at], min(a, b), max(a, b)) for at, a, b in lines):
        if out and out[-1][0] == at and a <= out[-1][2] + NEAR:
            out[-1] = (at, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((at, a, b))
    return out


def cells(across: list[Line], down: list[Line]) -> list[tuple[float, float, float, float]]:
    """The cells (x0, y0, x1, y1) between horizontal lines (y, x0, x1) and vertical ones (x, y0, y1)."""
    across, down = _merged(across), _merged(down)
    xs = [d[0] for d in down]
    rows: dict[int, list[int]] = defaultdict(list)  # the vertical lines that meet a horizontal one, from the left
    columns: dict[int, list[int]] = defaultdict(list)
    for i, (y, x0, x1) in enumerate(across):
        # only the lines within its stretch are looked at
        for j in range(bisect_left(xs, x0 - NEAR), len(xs)):
            if xs[j] > x1 + NEAR:
                break
            if down[j][1] - NEAR <= y <= down[j][2] + NEAR:
                rows[i].append(j)
                columns[j].append(i)
    meets = {(i, j) for i, js in rows.items() for j in js}
    out = []
    for i, j in sorted(meets):
        below, right = columns[j], rows[i]
        found = ((b, r) for b in below[below.index(i) + 1 :] for r in right[right.index(j) + 1 :] if (b, r) in meets)
        b, r = next(((b, r) for b, r in found if across[b][0] > across[i][0] and down[r][0] > down[j][0]), (None, None))
        if b is not None:
            out.append((down[j][0], across[i][0], down[r][0], across[b][0]))
    return out


def grids(found: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float, float, float]]]:
    """Cells in groups that share corners, in order of their first cells."""
    at: dict[tuple[float, float], list[int]] = defaultdict(list)
    for k, (x0, y0, x1, y1) in enumerate(found):
        for corner in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
            at[corner].append(k)
    seen, out = set(), []
    for k in range(len(found)):
        if k in seen:
            continue
        group, todo = [], [k]
        seen.add(k)
        while todo:
            x0, y0, x1, y1 = found[todo[-1]]
            group.append(todo.pop())
            for corner in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
                new = [n for n in at[corner] if n not in seen]
                seen.update(new)
                todo += new
        out.append([found[n] for n in sorted(group)])
    return out


def _tables(page: dict) -> dict[str, list]:
    boxes = list(zip(page["x0"], page["y0"], page["x1"], page["y1"], page["chars"], strict=True))
    lines = [b[:4] for b in boxes if b[4] is None]
    across = [((y0 + y1) / 2, x0, x1) for x0, y0, x1, y1 in lines if abs(x1 - x0) > NEAR >= abs(y1 - y0)]
    down = [((x0 + x1) / 2, y0, y1) for x0, y0, x1, y1 in lines if abs(y1 - y0) > NEAR >= abs(x1 - x0)]
    texts = [((x0 + x1) / 2, (y0 + y1) / 2, n) for x0, y0, x1, y1, n in boxes if n]
    made = []
    for grid in grids(cells(across, down)):
        n_rows, n_columns = len({c[1] for c in grid}), len({c[0] for c in grid})
        inside = [sum(n for x, y, n in texts if x0 <= x < x1 and y0 <= y < y1) for x0, y0, x1, y1 in grid]
        filled = sum(n > 0 for n in inside)
        if min(n_rows, n_columns) >= LEAST_SIDE and filled >= LEAST_FILLED:
            made.append({"n_rows": n_rows, "n_columns": n_columns, "n_cells": len(grid), "n_filled": filled, "chars": int(sum(inside))})
    return {"tables": made}


def tables(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """page, nth (from 0, from the top), n_rows, n_columns, n_cells, n_filled and chars of each table.

    ``lines`` have page and box (x0, y0, x1, y1), thin in one direction; ``spans`` page, box
    and text.  A table has LEAST_SIDE rows and columns and LEAST_FILLED cells with text at
    least; a text is in the cell that holds its centre.  Pages without tables give no rows.
    """
    box = ["page", "x0", "y0", "x1", "y1"]
    both = lines.select(*box, F.lit(None).cast("int").alias("chars")).unionByName(spans.select(*box, F.length(F.coalesce("text", F.lit(""))).alias("chars")))
    gathered = both.groupBy("page").agg(F.collect_list(F.struct(*box[1:], "chars")).alias("spans"))
    found = pages.page_by_page(gathered, "tables array<struct<n_rows:int,n_columns:int,n_cells:int,n_filled:int,chars:bigint>>", _tables)
    numbered = F.transform("tables", lambda t, i: F.struct(i.alias("nth"), *(t[c].alias(c) for c in ("n_rows", "n_columns", "n_cells", "n_filled", "chars"))))
    return found.select("page", F.inline(numbered))


def table_share(found: DataFrame, spans: DataFrame) -> DataFrame:
    """page and table_share: how much of a page's text lies in tables, 0 where there is none."""
    inside: Column = F.coalesce("_inside", F.lit(0))
    whole = spans.groupBy("page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("_whole"))
    in_tables = found.groupBy("page").agg(F.sum("chars").alias("_inside"))
    return whole.join(in_tables, "page", "left").select("page", F.coalesce(inside / F.nullif("_whole", F.lit(0)), F.lit(0.0)).alias("table_share"))
