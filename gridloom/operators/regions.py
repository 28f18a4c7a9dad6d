"""Whole region extraction: where a template's regions stand, what is in them, and what is left.

Steps, in this order: locate; cut before a run of blank rows; shrink to the text;
drop empty columns; then key-value pairs or a table's columns. Each step works on all
sheets and all regions at once. Anchors are found in one pass over the cells, cells
meet regions by row, and the cuts are windows over one partitioning by region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.a1 import letters
from gridloom.functions.text import matches, strip
from gridloom.operators.grid import SHEET, bounds, has_text, merge_members, numbered_rows
from gridloom.operators.template import Region

#: What names a region of a sheet: its number in the template and the number of its repeat.
BOX = [*SHEET, "k", "n"]
CORNERS = ["r0", "c0", "r1", "c1"]


@dataclass(frozen=True)
class Sheet:
    """The regions of the sheets whose name matches a pattern; a sheet belongs to the first that does."""

    sheet_id: str
    pattern: str
    regions: tuple[Region, ...] = ()
    required: bool = True


def _flat(sheets: tuple[Sheet, ...]) -> list[tuple[int, Region]]:
    return [(i, r) for i, s in enumerate(sheets) for r in sorted(s.regions, key=lambda r: (r.order, r.region_id))]


def _of(values: list, kind: str, at: str = "k") -> Column:
    """The value of a region's number."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(at)) if values else F.lit(None).cast(kind)


def _either(text: Column, exact: str | None, pattern: str | None) -> Column:
    out = F.lit(False) if exact is None else text == exact
    return out if pattern is None else out | matches(text, pattern)


def sheets_of(cells: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, i, r0, c0, r1, c1): each sheet with its bounds and the number of its template sheet, null for none."""
    which = F.coalesce(*[F.when(matches(F.col("sheet"), s.pattern), F.lit(i)) for i, s in enumerate(sheets)], F.lit(None).cast("int"))
    return bounds(cells).withColumn("i", which)


def located(cells: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, k, n, r0, c0, r1, c1): each region of each sheet; k is its number in the template, n that of its repeat.

    A fixed region stands where it is declared. An anchored one begins at its anchor
    and the offsets, not before the sheet, and ends after its height, else above its
    end anchor, else above the next repeat, else with the sheet.
    """
    flat = _flat(sheets)
    box = sheets_of(cells, sheets).where(F.col("i").isNotNull())
    fixed = [(k, i, r) for k, (i, r) in enumerate(flat) if r.range]
    anchored = [(k, i, r) for k, (i, r) in enumerate(flat) if not r.range]
    declared = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("of"), *[F.lit(x).alias(c) for c, x in zip(CORNERS, r.range)]) for k, i, r in fixed]) if fixed else F.array().cast("array<struct<k:int,of:int,r0:int,c0:int,r1:int,c1:int>>")
    still = box.select(*SHEET, "i", F.explode(declared).alias("x")).where(F.col("x.of") == F.col("i")).select(*SHEET, "x.k", F.lit(1).alias("n"), *[f"x.{c}" for c in CORNERS])
    if not anchored:
        return still
    text = strip(F.coalesce("display", F.lit("")))
    mark = lambda k, end: F.struct(F.lit(k).alias("k"), F.lit(end).alias("end"))
    hits = []
    for k, i, r in anchored:
        here = F.col("i") == i
        hits.append(F.when(here & _either(text, r.anchor_text, r.anchor_pattern), mark(k, False)))
        if r.end_text is not None or r.end_pattern is not None:
            hits.append(F.when(here & _either(text, r.end_text, r.end_pattern), mark(k, True)))
    own = box.select(*SHEET, "i", *[F.col(c).alias(f"s_{c}") for c in CORNERS])
    found = cells.join(own, SHEET).withColumn("x", F.explode(F.array_compact(F.array(*hits)))).select(*SHEET, "row", "col", *[f"s_{c}" for c in CORNERS], "x.*")
    settings = [r for _, r in flat]
    order = Window.partitionBy(*SHEET, "k").orderBy("row", "col")
    starts = found.where(~F.col("end")).withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("row").over(order))
    repeats = _of([r.repeat for r in settings], "boolean")
    starts = starts.where(repeats | (F.col("n") == 1)).withColumn("next", F.when(repeats, F.col("next")))
    starts = starts.withColumns({"r0": F.greatest(F.col("s_r0"), F.col("row") + _of([r.row_offset for r in settings], "int")), "c0": F.greatest(F.col("s_c0"), F.col("col") + _of([r.col_offset for r in settings], "int"))})
    # The first end below a start: starts and ends stand in one order, by row.
    points = starts.select(*SHEET, "k", "n", F.col("r0").alias("at"), F.lit(None).cast("int").alias("e")).unionByName(found.where("end").select(*SHEET, "k", F.lit(None).cast("int").alias("n"), F.col("row").alias("at"), F.col("row").alias("e")))
    below = Window.partitionBy(*SHEET, "k").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    ends = points.withColumn("e", F.min("e").over(below)).where(F.col("n").isNotNull()).select(*SHEET, "k", "n", "e")
    rows = starts.drop("end").join(ends, [*SHEET, "k", "n"]).withColumn("e", F.when(F.col("next").isNull() | (F.col("e") < F.col("next")), F.col("e")))
    height, width = _of([r.height for r in settings], "int"), _of([r.width for r in settings], "int")
    r1 = F.coalesce(F.col("r0") + height - 1, F.col("e") - 1, F.col("next") - 1, F.greatest("r0", "s_r1"))
    c1 = F.coalesce(F.col("c0") + width - 1, F.greatest("c0", "s_c1"))
    return still.unionByName(rows.select(*SHEET, "k", "n", "r0", "c0", F.greatest(r1, F.col("r0")).alias("r1"), F.greatest(c1, F.col("c0")).alias("c1")))


def with_masters(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells with mr and mc, the address of their merge master (null if they are their own), and master, its text."""
    own = merge_members(merges).where((F.col("row") != F.col("mr")) | (F.col("col") != F.col("mc")))
    masters = cells.where(has_text(F.col("display"))).select(*SHEET, F.col("row").alias("mr"), F.col("col").alias("mc"), strip(F.col("display")).alias("master"))
    return cells.join(own.join(masters, [*SHEET, "mr", "mc"]), [*SHEET, "row", "col"], "left")


def _shown() -> Column:
    """A cell's own text, or that of its master where it lies in the region; null for none."""
    inside = F.col("mr").between(F.col("r0"), F.col("r1")) & F.col("mc").between(F.col("c0"), F.col("c1"))
    return F.when(has_text(F.col("display")), strip(F.col("display"))).when(inside, F.col("master"))


def members(cells: DataFrame, merges: DataFrame, boxes: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """The cells of each region with its final corners; columns of BOX, CORNERS, cells and `shown`, the text with its master's.

    A region may lose rows after a run of blank ones, what lies outside its text, and
    columns without text, inner ones too, as its settings say. What would leave
    nothing is not done. Regions may share cells. A region without cells has no rows.
    """
    settings = [r for _, r in _flat(sheets)]
    area = bounds(cells).select(*SHEET, F.col("r0").alias("lo"), F.col("r1").alias("hi"))
    reach = F.when(F.greatest("r0", "lo") <= F.least("r1", "hi"), F.sequence(F.greatest("r0", "lo"), F.least("r1", "hi")))
    by_row = boxes.join(area, SHEET).withColumn("row", F.explode(reach)).drop("lo", "hi")
    rows = with_masters(cells, merges).join(by_row, [*SHEET, "row"]).where(F.col("col").between(F.col("c0"), F.col("c1")))
    box = Window.partitionBy(*BOX)
    full = _shown().isNotNull()
    stop = _of([r.stop_after for r in settings], "int")
    before = F.coalesce(F.max(F.when(F.col("full"), F.col("row"))).over(box.orderBy("row").rangeBetween(Window.unboundedPreceding, -1)), F.col("r0") - 1)
    rows = rows.withColumn("full", full).withColumn("before", before)
    cut = F.min(F.when(F.col("full") & (F.col("row") - F.col("before") - 1 >= stop), F.col("before"))).over(box)
    last = F.coalesce(F.max(F.when(F.col("full"), F.col("row"))).over(box), F.col("r0") - 1)
    rows = rows.withColumns({"cut": cut, "last": last})
    tail = F.when(F.col("r1") - F.col("last") >= stop, F.col("last"))
    rows = rows.withColumn("r1", F.when(stop > 0, F.greatest("r0", F.coalesce("cut", tail, "r1"))).otherwise(F.col("r1"))).where(F.col("row") <= F.col("r1"))

    span = lambda name: F.greatest(F.coalesce(F.col(name), F.lit(1)), F.lit(1)) - 1 if name in cells.columns else F.lit(0)
    rows = rows.withColumn("full", full)
    seen = lambda f, c: f(F.when(F.col("full"), c)).over(box)
    rows = rows.withColumns({"b_r0": seen(F.min, F.col("row")), "b_c0": seen(F.min, F.col("col")), "b_r1": seen(F.max, F.col("row") + span("row_span")), "b_c1": seen(F.max, F.col("col") + span("col_span"))})
    shrink = _of([r.shrink for r in settings], "boolean") & F.col("b_r0").isNotNull()
    rows = rows.withColumns({c: F.when(shrink, F.col(f"b_{c}")).otherwise(F.col(c)) for c in CORNERS})
    rows = rows.where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))

    trim = _of([r.kind == "table" if r.trim is None else r.trim for r in settings], "boolean")
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"any": F.bool_or("full").over(box), "column": F.bool_or("full").over(Window.partitionBy(*BOX, "col")), "b_c0": seen(F.min, F.col("col")), "b_c1": seen(F.max, F.col("col"))})
    trim = trim & F.col("any")
    rows = rows.withColumns({"c0": F.when(trim, F.col("b_c0")).otherwise(F.col("c0")), "c1": F.when(trim, F.col("b_c1")).otherwise(F.col("c1")), "keep": ~trim | F.col("column")}).where("keep")
    return rows.withColumn("shown", _shown()).select(*BOX, *CORNERS, *[c for c in cells.columns if c not in SHEET], "mr", "mc", "shown")


def _named(rows: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """rows with region and title: repeats after the first have their number at the end."""
    settings = [r for _, r in _flat(sheets)]
    name, title = _of([r.region_id for r in settings], "string"), _of([r.title for r in settings], "string")
    again = F.col("n") > 1
    return rows.withColumns({"region": F.when(again, F.concat(name, F.lit("-"), F.col("n").cast("string"))).otherwise(name), "title": F.when(again, F.concat(title, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(title)})


def regions(boxes: DataFrame, held: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, k, n, region, title, kind, confidence, ignore, r0, c0, r1, c1, cells): each region with its final corners.

    held are its members(). An ignored region keeps the corners where it was located,
    takes its cells and shows nothing.
    """
    settings = [r for _, r in _flat(sheets)]
    final = held.groupBy(*BOX).agg(*[F.first(c).alias(f"f_{c}") for c in CORNERS], F.count("*").alias("cells"))
    stop = _of([r.stop_after for r in settings], "int")
    ignore = _of([r.ignore for r in settings], "boolean")
    empty = F.when((stop > 0) & (F.col("r1") - F.col("r0") + 1 >= stop), F.col("r0")).otherwise(F.col("r1"))
    rows = boxes.join(final, BOX, "left")
    corner = {c: F.when(ignore, F.col(c)).otherwise(F.coalesce(f"f_{c}", empty if c == "r1" else F.col(c))) for c in CORNERS}
    rows = _named(rows.withColumns(corner), sheets)
    return rows.select(*BOX, "region", "title", _of([r.kind for r in settings], "string").alias("kind"), _of([1.0 if r.range else 0.9 for r in settings], "double").alias("confidence"), ignore.alias("ignore"), *CORNERS, F.coalesce("cells", F.lit(0)).alias("cells"))


def pairs(held: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, k, n, region, name, value) of the key-value regions; of equal names the last row wins.

    A formula's value is what it shows; otherwise the raw value, or else the text.
    """
    settings = [r for _, r in _flat(sheets)]
    at = lambda values: F.col("c0") + _of(values, "int") - 1
    key, value = at([r.key_col for r in settings]), at([r.value_col for r in settings])
    text = F.coalesce("raw", "display") if "raw" in held.columns else F.col("display")
    text = F.when(F.col("formula").isNotNull(), F.col("display")).otherwise(text) if "formula" in held.columns else text
    mine = held.where((_of([r.kind for r in settings], "string") == "key_value") & (F.col("row") >= F.col("r0") + _of([r.header_rows for r in settings], "int")))
    rows = mine.groupBy(*BOX, "row").agg(F.max(F.when(F.col("col") == key, strip(F.col("display")))).alias("key"), F.max(F.when(F.col("col") == value, text)).alias("value")).where(has_text(F.col("key")))
    name = F.col("key")
    for k, r in enumerate(settings):
        if r.keys:
            own = F.coalesce(*[F.when(F.col("key") == x, F.lit(y)) for x, y in r.keys], *[F.when(matches(F.col("key"), x), F.lit(y)) for x, y in r.keys])
            name = F.when(F.col("k") == k, F.coalesce(own, "key")).otherwise(name)
    return _named(rows.withColumn("name", name).groupBy(*BOX, "name").agg(F.max_by("value", "row").alias("value")), sheets).drop("title")


def columns(held: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, k, n, region, col, label, semantic) for each column of the table regions.

    The label joins the distinct texts of the header rows, top down. A meaning is
    given by the column's number in the region, its letters, its label, or the first
    pattern that its label matches; only the first column of each meaning has it.
    """
    settings = [r for _, r in _flat(sheets)]
    tables = held.where(_of([r.kind for r in settings], "string") == "table")
    heads = tables.where((F.col("row") < F.col("r0") + _of([r.header_rows for r in settings], "int")) & F.col("shown").isNotNull())
    once = heads.groupBy(*BOX, "col", "shown").agg(F.min("row").alias("row"))
    labels = once.groupBy(*BOX, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "shown"))), lambda x: x["shown"]), " / ").alias("label"))
    spine = tables.select(*BOX, "c0", "c1").distinct().select(*BOX, "c0", F.explode(F.sequence("c0", "c1")).alias("col"))
    rows = spine.join(labels, [*BOX, "col"], "left").withColumn("label", F.coalesce("label", F.lit("")))
    number, letter = (F.col("col") - F.col("c0") + 1).cast("string"), letters(F.col("col"))
    meaning = F.lit(None).cast("string")
    for k, r in enumerate(settings):
        if r.columns:
            exact = [F.when(c == x, F.lit(y)) for c in (number, letter, F.col("label")) for x, y in r.columns]
            meaning = F.when(F.col("k") == k, F.coalesce(*exact, *[F.when(matches(F.col("label"), x), F.lit(y)) for x, y in r.columns])).otherwise(meaning)
    first = F.row_number().over(Window.partitionBy(*BOX, "semantic").orderBy("col")) == 1
    rows = rows.withColumn("semantic", meaning).withColumn("semantic", F.when(first, F.col("semantic")))
    return _named(rows, sheets).select(*BOX, "region", "col", "label", "semantic")


def not_found(cells: DataFrame, boxes: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, code, severity, name): regions that a sheet lacks, and required sheets that a document lacks.

    A region is an error if required, else a warning.
    """
    flat = _flat(sheets)
    here = sheets_of(cells, sheets).select(*SHEET, "i")
    of = lambda entries: F.array(*[F.struct(F.lit(i).alias("of"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(need).alias("need")) for i, k, name, need in entries])
    out = here.select(*SHEET, F.lit("").alias("code"), F.lit("").alias("severity"), F.lit("").alias("name")).where(F.lit(False))
    if flat:
        wanted = here.select(*SHEET, "i", F.explode(of([(i, k, r.region_id, r.required) for k, (i, r) in enumerate(flat)])).alias("x")).where(F.col("x.of") == F.col("i")).select(*SHEET, "x.k", "x.name", "x.need")
        gone = wanted.join(boxes.select(*SHEET, "k").distinct(), [*SHEET, "k"], "left_anti")
        out = out.unionByName(gone.select(*SHEET, F.lit("template.region_not_found").alias("code"), F.when(F.col("need"), "error").otherwise("warning").alias("severity"), "name"))
    needed = [(i, 0, s.sheet_id, True) for i, s in enumerate(sheets) if s.required]
    if needed:
        # A sheet counts for each pattern that it matches, not only for the first.
        has = F.array_compact(F.array(*[F.when(matches(F.col("sheet"), sheets[i].pattern), F.lit(i)) for i, *_ in needed]))
        met = here.select("doc", F.explode(has).alias("of")).distinct()
        wanted = here.select("doc").distinct().select("doc", F.explode(of(needed)).alias("x")).select("doc", "x.of", "x.name")
        gone = wanted.join(met, ["doc", "of"], "left_anti")
        out = out.unionByName(gone.select("doc", F.lit(None).cast("string").alias("sheet"), F.lit("business.required_sheet").alias("code"), F.lit("error").alias("severity"), "name"))
    return out


def leftover(cells: DataFrame, found: DataFrame, sheets: tuple[Sheet, ...]) -> DataFrame:
    """(doc, sheet, region, r0, c0, r1, c1, cells): what no region of regions() holds, in blocks of text.

    Blocks are runs of rows, cut at bold ones, and in them runs of columns. Cells
    outside them make up one more region of the sheet. Names begin with
    unrecognized, in sheets without a template sheet with freeform.
    """
    area = sheets_of(cells, sheets).select(*SHEET, "i", F.col("r0").alias("lo"), F.col("r1").alias("hi"))
    reach = F.when(F.greatest("r0", "lo") <= F.least("r1", "hi"), F.sequence(F.greatest("r0", "lo"), F.least("r1", "hi")))
    taken = found.join(area, SHEET).withColumn("row", F.explode(reach)).select(*SHEET, "row", F.col("c0").alias("t0"), F.col("c1").alias("t1"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*SHEET, "row")]
    rest = cells.alias("x").join(taken.alias("y"), same[0] & same[1] & same[2] & F.col("x.col").between(F.col("y.t0"), F.col("y.t1")), "left_anti")
    rows = rest.join(numbered_rows(rest), [*SHEET, "row"], "left")
    order = Window.partitionBy(*SHEET, "band").orderBy("col")
    wide = rows.where(has_text(F.col("display")) & F.col("band").isNotNull()).groupBy(*SHEET, "band", "col").agg(F.lit(1).alias("one"))
    wide = wide.withColumn("new", F.coalesce((F.col("col") - F.lag("col").over(order) > 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = wide.groupBy(*SHEET, "band", "island").agg(F.min("col").alias("i0"), F.max("col").alias("i1"))
    # Runs of columns of one band lie apart, so a cell meets one of them at most.
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*SHEET, "band")]
    placed = rows.alias("x").join(islands.alias("y"), on[0] & on[1] & on[2] & F.col("x.col").between(F.col("y.i0"), F.col("y.i1")), "left").select("x.*", "y.island", "y.i0", "y.i1")
    spread = numbered_rows(rest).groupBy(*SHEET, "band").agg(F.min("row").alias("b0"), F.max("row").alias("b1"))
    inside = placed.where(F.col("island").isNotNull()).groupBy(*SHEET, "band", "island").agg(F.first("i0").alias("c0"), F.first("i1").alias("c1"), F.count("*").alias("cells")).join(spread, [*SHEET, "band"])
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("band", "island")).cast("string")
    blocks = inside.select(*SHEET, place.alias("name"), F.col("b0").alias("r0"), "c0", F.col("b1").alias("r1"), "c1", "cells")
    outside = placed.where(F.col("island").isNull()).groupBy(*SHEET).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"), F.count("*").alias("cells"))
    both = blocks.unionByName(outside.withColumn("name", F.lit("grid-residual"))).join(area.select(*SHEET, "i"), SHEET)
    prefix = F.when(F.col("i").isNull(), "freeform-").otherwise("unrecognized-")
    return both.select(*SHEET, F.concat(prefix, F.col("name")).alias("region"), *CORNERS, "cells")
