"""Where something was read: one tagged, wide struct for every kind of place.

Kinds with the same fields (characters and bytes) stay apart by their tag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (
    ("kind", "string"), ("start", "bigint"), ("end", "bigint"), ("start_s", "double"), ("end_s", "double"), ("page", "int"),
    ("x", "double"), ("y", "double"), ("w", "double"), ("h", "double"), ("sheet", "string"), ("row", "int"), ("col", "int"), ("rows", "int"), ("cols", "int"), ("part", "string"),
)
SCHEMA = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">"


def _locator(kind: str, **given) -> Column:
    vals = {"kind": F.lit(kind)} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items() if v is not None}
    return F.struct(*(vals.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS))


def char_span(start, end) -> Column:
    return _locator("chars", start=start, end=end)


def byte_range(start, end) -> Column:
    return _locator("bytes", start=start, end=end)


def time_span(start_s, end_s) -> Column:
    return _locator("time", start_s=start_s, end_s=end_s)


def page_ref(page) -> Column:
    return _locator("page", page=page)


def bbox(x, y, w, h, page=None) -> Column:
    return _locator("bbox", x=x, y=y, w=w, h=h, page=page)


def cell_range(sheet, row, col, rows=1, cols=1) -> Column:
    return _locator("cells", sheet=sheet, row=row, col=col, rows=rows, cols=cols)


def part_span(part, start, end) -> Column:
    return _locator("part", part=part, start=start, end=end)


def valid(loc: Column) -> Column:
    """Whether a locator keeps the rules of its kind: nothing of zero width, boxes inside the unit square."""
    span = (loc["start"] >= 0) & (loc["start"] < loc["end"])
    inside = (loc["x"] >= 0) & (loc["y"] >= 0) & (loc["w"] > 0) & (loc["h"] > 0) & (loc["x"] + loc["w"] <= 1) & (loc["y"] + loc["h"] <= 1)
    return F.coalesce(
        F.when(loc["kind"].isin("chars", "bytes"), span)
        .when(loc["kind"] == "part", span & (F.trim(loc["part"]) != ""))
        .when(loc["kind"] == "time", (loc["start_s"] >= 0) & (loc["start_s"] < loc["end_s"]))
        .when(loc["kind"] == "page", loc["page"] >= 1)
        .when(loc["kind"] == "bbox", inside)
        .when(loc["kind"] == "cells", (F.trim(loc["sheet"]) != "") & (loc["row"] >= 0) & (loc["col"] >= 0) & (loc["rows"] >= 1) & (loc["cols"] >= 1)),
        F.lit(False),
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap."""
    return (a_start < b_end) & (b_start < a_end)


def describe(loc: Column) -> Column:
    """A locator as a short text."""
    n = lambda c: c.cast("string")
    return (
        F.when(loc["kind"] == "chars", F.concat(F.lit("characters "), n(loc["start"]), F.lit("-"), n(loc["end"])))
        .when(loc["kind"] == "bytes", F.concat(F.lit("bytes "), n(loc["start"]), F.lit("-"), n(loc["end"])))
        .when(loc["kind"] == "part", F.concat(loc["part"], F.lit(" characters "), n(loc["start"]), F.lit("-"), n(loc["end"])))
        .when(loc["kind"] == "time", F.concat(F.lit("seconds "), n(loc["start_s"]), F.lit("-"), n(loc["end_s"])))
        .when(loc["kind"] == "page", F.concat(F.lit("page "), n(loc["page"])))
        .when(loc["kind"] == "bbox", F.concat(F.lit("box "), F.concat_ws(",", *(n(loc[k]) for k in "xywh"))))
        .otherwise(F.concat(loc["sheet"], F.lit(" r"), n(loc["row"]), F.lit("c"), n(loc["col"])))
    )
