"""Layout of pages from spans of text: visible boxes, columns, reading order, rows and sections.

A span has page, span (its number), text, x0, y0, x1, y1 and size.  Pages are small and
independent: columns, reading order and rows are found a page at a time, from all its
spans, which one exchange brings together.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitforge.functions import resumes
from fitforge.functions.postings import stripped, words_in
from fitforge.operators import layout

# The least size of text, the whiteness of hidden text, the darkness behind which it shows, the share of a page of a big image.
LEAST_SIZE, NEAR_WHITE, DARK, BIG = 4, 0xF0, 0.85, 0.25
# The band above the body, the middle in which a gutter can lie, its least width, spans of a body.
_BAND, _MIDDLE, _LEAST_GUTTER, _LEAST_SPANS = 0.12, (0.15, 0.85), 8, 10


def visible_boxes(spans: DataFrame) -> DataFrame:
    """Spans without blanks around them, their boxes shrunk by as much; without empty, tiny and transparent ones."""
    text, width = F.col("text"), F.col("x1") - F.col("x0")
    n = F.length(text)
    lead, trail = n - F.length(F.regexp_replace(text, r"^\s+", "")), n - F.length(F.regexp_replace(text, r"\s+$", ""))
    shown = spans.where((stripped(text) != "") & (F.col("size") >= LEAST_SIZE) & (F.coalesce("alpha", F.lit(255)) != 0))
    return shown.withColumns({"text": stripped(text), "x0": F.col("x0") + width * lead / n, "x1": F.col("x1") - width * trail / n, "size": F.round("size", 1)})


def is_near_white(colour: Column) -> Column:
    """Whether all channels of a colour (0xRRGGBB) are nearly full."""
    return F.least(*(F.shiftright(colour, s).bitwiseAND(255) for s in (16, 8, 0))) >= NEAR_WHITE


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The common stretch of two intervals as a share of the shorter one."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / F.when(shorter == 0, 0.1).otherwise(shorter)


def _inside(rect: str) -> Column:
    """Whether the centre of a span lies in a rectangle with this prefix."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return x.between(F.col(f"{rect}x0"), F.col(f"{rect}x1")) & y.between(F.col(f"{rect}y0"), F.col(f"{rect}y1"))


def _prefixed(rects: DataFrame) -> DataFrame:
    return rects.select(*(F.col(c).alias(c if c == "page" else f"r_{c}") for c in rects.columns))


def without_hidden(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """Spans without near-white text, unless a dark filled rectangle (page, box, darkness of its brightest channel) lies behind."""
    dark = _prefixed(rects.where(F.col("brightest") < DARK))
    white = spans.where(is_near_white(F.col("colour")))
    return spans.where(~is_near_white(F.col("colour"))).unionByName(white.join(dark, (white["page"] == dark["page"]) & _inside("r_"), "left_semi"))


def big_images(images: DataFrame, spans: DataFrame, width: float, height: float) -> DataFrame:
    """page, share of the page and characters over it of each big image (page, image: its number, box).

    Boxes that are alike when rounded (halves to the even number) are one image, the first.
    """
    box = ["x0", "y0", "x1", "y1"]
    alike = [F.bround(c).cast("long").alias(f"_{c}") for c in box]
    # of boxes that round alike the first one stands for all
    first = F.min(F.struct("image", *box)).alias("first")
    one = images.select("page", "image", *box, *alike).groupBy("page", *(f"_{c}" for c in box)).agg(first).select("page", "first.*")
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (width * height)
    big = _prefixed(one.select("page", *box, share.alias("share")).where(F.col("share") >= BIG))
    over = big.join(spans, (big["page"] == spans["page"]) & _inside("r_"), "left")
    return over.groupBy(big["page"], "r_x0", "r_y0", "r_x1", "r_y1", "r_share").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select("page", F.col("r_share").alias("share"), "chars")


_BOX = ["x0", "y0", "x1", "y1"]


def _gathered(spans: DataFrame) -> DataFrame:
    """One row per page, ``spans`` in the order of their numbers."""
    return spans.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("span", *(c for c in spans.columns if c not in ("page", "span"))))).alias("spans"))


def page_by_page(pages: DataFrame, made: str, f: Callable[[dict], dict[str, list]]) -> DataFrame:
    """``pages`` with columns ``made`` (DDL) as ``f`` gives them for the spans of a page, a dict of lists."""
    new = T.StructType.fromDDL(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            fields = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
            whole = {n: x.to_numpy(zero_copy_only=False) if pa.types.is_floating(x.type) else x.to_pylist() for n, x in fields.items()}
            found = [f({n: x[a:b] for n, x in whole.items()}) for a, b in zip([0, *ends], ends, strict=False)]
            arrays = [pa.array([x[c.name] for x in found], _arrow(c.dataType)) for c in new]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new.names])

    return pages.mapInArrow(run, T.StructType([*pages.schema, *new]))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind.simpleString()]


def _gutter(page: dict, width: float, height: float) -> float | None:
    """x of the widest strip in the middle that hardly any span crosses, with text enough on both sides.

    Short spans on the right that share their rows with the left (dates of jobs) are no column.
    """
    x0, y0, x1, y1 = (page[c] for c in _BOX)
    chars = np.array([len(t) for t in page["text"]])
    body = y0 > height * _BAND
    n = int(body.sum())
    if n < _LEAST_SPANS:
        return None
    starts = np.maximum(x0[body].astype(np.int64), 0)
    ends = np.minimum(np.ceil(x1[body]).astype(np.int64), int(width))
    steps, there = np.zeros(int(width) + 3, np.int64), starts <= ends
    np.add.at(steps, starts[there], 1)
    np.add.at(steps, ends[there] + 1, -1)
    low, high = int(width * _MIDDLE[0]), int(width * _MIDDLE[1])
    blocked = np.concatenate(([low - 1], low + np.flatnonzero(np.cumsum(steps)[low : high + 1] > max(1, int(n * 0.03))), [high + 1]))
    clear = np.diff(blocked) - 1
    at = int(clear.argmax())
    if clear[at] < _LEAST_GUTTER:
        return None
    gutter = float(blocked[at] + 1 + clear[at] / 2)
    left, right = body & (x1 <= gutter), body & (x0 >= gutter)
    total = chars[body].sum()
    if chars[left].sum() < 0.15 * total or chars[right].sum() < 0.15 * total:
        return None
    common = np.minimum(y1[right][:, None], y1[left]) - np.maximum(y0[right][:, None], y0[left])
    shorter = np.minimum((y1 - y0)[right][:, None], (y1 - y0)[left])
    beside = (np.maximum(common, 0) / np.where(shorter == 0, 0.1, shorter) >= 0.5).any(axis=1)
    dates = chars[right][beside].sum() / chars[right].sum() >= 0.4 and statistics.median(chars[right].tolist()) < 25
    return None if dates else gutter


def _regions(page: dict, gutter: float | None, height: float) -> list[int]:
    """0 above the columns or without them, 1 left (and across), 2 right."""
    x0, y0, x1, y1 = (page[c] for c in _BOX)
    if gutter is None:
        return [0] * len(x0)
    beside = (y0 > height * _BAND) & ((x1 <= gutter) | (x0 >= gutter))
    top = y0[beside].min() if beside.any() else 0.0
    return np.where(y1 <= top, 0, np.where(x0 >= gutter, 2, 1)).tolist()


def gutters(spans: DataFrame, width: int, height: int) -> DataFrame:
    """page and gutter (x) of the pages with two columns."""
    found = page_by_page(_gathered(spans), "gutter double", lambda page: {"gutter": _gutter(page, width, height)})
    return found.where("gutter is not null").select("page", "gutter")


def page_regions(spans: DataFrame, width: int, height: int) -> DataFrame:
    """Spans with ``region``: 0 above the columns or on pages without, 1 left (and across), 2 right."""
    found = page_by_page(_gathered(spans), "regions array<int>", lambda page: {"regions": _regions(page, _gutter(page, width, height), height)})
    return found.select("page", F.inline(F.transform("spans", lambda s, i: s.withField("region", F.col("regions")[i])))).select(*spans.columns, "region")


def _row_numbers(boxes: list[tuple[float, float, float]]) -> list[int]:
    """The row of each span (y0, y1, x0): from the top, a span joins the last of four rows that it overlaps by half."""
    rows: list[list[float]] = []
    out = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: ((boxes[i][0] + boxes[i][1]) / 2, boxes[i][2])):
        y0, y1, _ = boxes[i]
        for r in range(len(rows) - 1, max(-1, len(rows) - 5), -1):
            a0, a1 = rows[r]
            if max(min(y1, a1) - max(y0, a0), 0) / (min(y1 - y0, a1 - a0) or 0.1) >= 0.5:
                rows[r] = [min(a0, y0), max(a1, y1)]
                break
        else:
            r = len(rows)
            rows.append([y0, y1])
        out[i] = r
    return out


_ROW = "place int, region int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, all_caps boolean, starts_bold boolean, first_text string, second_x0 double"


def _row(spans: list[dict]) -> dict:
    """What a row of spans, from left to right, is like."""
    text = spans[0]["text"]
    for before, s in zip(spans, spans[1:], strict=False):
        text += (" " if s["x0"] - before["x1"] > 0.15 * s["size"] else "") + s["text"]
    text = re.sub(r"\s+", " ", text).strip()
    worded = [s for s in spans if any(map(str.isalpha, s["text"]))]
    letters = [c for c in text if c.isalpha()]
    return {
        "text": text, "x0": spans[0]["x0"], "y0": min(s["y0"] for s in spans), "x1": max(s["x1"] for s in spans), "y1": max(s["y1"] for s in spans), "size": max(s["size"] for s in spans),
        "bold": bool(worded) and all(s["bold"] for s in worded), "italic": bool(worded) and all(s["italic"] for s in worded), "starts_bold": bool(worded) and bool(worded[0]["bold"]),
        "all_caps": len(letters) >= 2 and all(map(str.isupper, letters)), "first_text": spans[0]["text"], "second_x0": spans[1]["x0"] if len(spans) > 1 else None,
    }


def _rows_of(page: dict, regions: list[int]) -> list[dict]:
    """The rows of a page: by region, from the top, from the left."""
    each = [{c: page[c][i] for c in (*_BOX, "text", "size", "bold", "italic")} for i in range(len(regions))]
    out = []
    for region in (0, 1, 2):
        mine = [s for s, r in zip(each, regions, strict=True) if r == region]
        mine.sort(key=lambda s: ((s["y0"] + s["y1"]) / 2, s["x0"]))
        rows: dict[int, list[dict]] = {}
        for s, r in zip(mine, _row_numbers([(s["y0"], s["y1"], s["x0"]) for s in mine]), strict=True):
            rows.setdefault(r, []).append(s)
        made = [{"region": region} | _row(sorted(r, key=lambda s: s["x0"])) for r in rows.values()]
        out += sorted(made, key=lambda r: (r["y0"], r["x0"]))
    return [r | {"place": k} for k, r in enumerate(out)]


def page_rows(spans: DataFrame, width: int, height: int) -> DataFrame:
    """The rows of each page in reading order: place, region, text, box, size, bold, italic, all_caps, starts_bold, first_text, second_x0.

    Spans (with bold and italic) of a region whose boxes overlap are a row.  Texts that lie
    apart by more than 0.15 of the size have a blank between them, and blanks in a row
    are single ones.  A row is bold or italic if all its spans with letters are, starts
    bold if the first of these is, and is in capitals if it has two letters and all are.
    """
    return _in_rows(spans, lambda page: _regions(page, _gutter(page, width, height), height))


def text_rows(spans: DataFrame) -> DataFrame:
    """The rows of spans that have their ``region``, as :func:`page_rows` describes them."""
    return _in_rows(spans, lambda page: page["region"])


def _in_rows(spans: DataFrame, regions: Callable[[dict], list[int]]) -> DataFrame:
    found = page_by_page(_gathered(spans), f"rows array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>", lambda page: {"rows": _rows_of(page, regions(page))})
    return found.select("page", F.inline("rows"))


def headed_rows(rows: DataFrame, document: str, place: str) -> DataFrame:
    """Rows (text, size, bold, all_caps) with ``key``, the section of a heading, and ``section``, that of the last heading at or above.

    Headings are short lines that stand out and have the words of a section; of these
    only those in the most frequent style, or in capitals, count, and further lines in
    that style are headings of other sections.  Without any, large lines in capitals are.
    """
    along = Window.partitionBy(document).orderBy(place)
    text = F.col("text")
    sizes = layout.first_weighted_mode(rows.withColumn("_size", F.round("size", 1)), document, "_size", F.length("text"), place).withColumnRenamed("_size", "_body")
    stands_out = F.col("bold") | F.col("all_caps") | (F.col("size") >= F.col("_body") + 1)
    short = words_in(resumes.normalised_heading(text)).between(1, 6) & ~text.rlike(r"\d") & (F.length(text) <= 50) & ~text.rlike(r":\s*\S")
    core = F.regexp_replace(text, r"[\s:|]+$", "")
    marked = rows.join(sizes.select(document, "_body"), document).withColumn("_can", short & (core != "") & ~core.rlike("[.,;]$") & stands_out)
    marked = marked.withColumn("_key", F.when(F.col("_can"), resumes.heading_key(text))).withColumn("_rounded", F.round("size").cast("int"))
    style = layout.first_mode(marked.where("_key is not null"), document, ["_rounded", "bold", "all_caps"], place)
    style = style.select(document, F.struct("_rounded", "bold", "all_caps").alias("_style"))
    joined = marked.join(style, document, "left")
    same = F.struct("_rounded", "bold", "all_caps") == F.col("_style")
    kept = F.when(F.col("_key").isNotNull() & (same | F.col("all_caps")), F.col("_key"))
    joined = joined.withColumn("_kept", kept)
    first = F.min(F.when(F.col("_kept").isNotNull(), F.col(place))).over(Window.partitionBy(document))
    large = F.col("_style").isNull() & F.col("all_caps") & (F.col("size") >= F.col("_body") + 2) & F.col("_can")
    other = (F.coalesce(same, F.lit(False)) & F.col("_can") & (F.col(place) > F.col("_first"))) | large
    keyed = joined.withColumn("_first", first).withColumn("key", F.coalesce("_kept", F.when(other, F.lit("other"))))
    section = F.coalesce(F.last("key", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit("header"))
    return keyed.withColumn("section", section).select(*rows.columns, "key", "section")
