"""Relational algebra over sparse grids: cells(doc, sheet, row, col, display, ...).

Every operator is keyed by (doc, sheet), so plans spread over documents; windows
never run over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import strip

SHEET = ["doc", "sheet"]


def has_text(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def first_per_address(cells: DataFrame, order: str) -> DataFrame:
    """One cell for each address: the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*SHEET, "row", "col").orderBy(order))
    return cells.withColumn("place", place).where(F.col("place") == 1).drop("place")


def bounds(cells: DataFrame, spans: bool = False) -> DataFrame:
    """(doc, sheet, r0, c0, r1, c1) around the cells, or around the areas they span."""
    last = lambda at, span: F.max(F.col(at) + F.coalesce(F.col(span), F.lit(1)) - 1) if spans else F.max(at)
    return cells.groupBy(*SHEET).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), last("row", "row_span").alias("r1"), last("col", "col_span").alias("c1"))


def rectangle(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    return cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def densify(cells: DataFrame) -> DataFrame:
    """(doc, sheet, row, col, display): every address inside a sheet's bounds; absent cells have no display."""
    box = bounds(cells)
    rows = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return rows.select(*SHEET, "row", "col").join(cells.select(*SHEET, "row", "col", "display"), [*SHEET, "row", "col"], "left")


def merge_members(merges: DataFrame) -> DataFrame:
    """(doc, sheet, row, col, mr, mc): each address of a merged range with that of its master."""
    rows = merges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return rows.select(*SHEET, "row", "col", F.col("r0").alias("mr"), F.col("c0").alias("mc"))


def _with_master(cells: DataFrame, merges: DataFrame) -> DataFrame:
    masters = cells.select(*SHEET, F.col("row").alias("mr"), F.col("col").alias("mc"), F.col("display").alias("master_display"))
    return cells.join(merge_members(merges), [*SHEET, "row", "col"], "left").join(masters, [*SHEET, "mr", "mc"], "left")


def merge_expand(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Members of merged ranges with their master's address and text, and the master's spans."""
    spans = merges.select(*SHEET, F.col("r0").alias("mr"), F.col("c0").alias("mc"), (F.col("r1") - F.col("r0") + 1).alias("row_span"), (F.col("c1") - F.col("c0") + 1).alias("col_span"))
    rows = _with_master(cells, merges).where(F.col("mr").isNotNull()).join(spans, [*SHEET, "mr", "mc"])
    return rows.select(*SHEET, "row", "col", "mr", "mc", "master_display", "row_span", "col_span")


def merge_fill(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Members show the text of their master."""
    return _with_master(cells, merges).select(*SHEET, "row", "col", F.when(F.col("mr").isNotNull(), F.col("master_display")).otherwise(F.col("display")).alias("display"))


def merge_blank(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Members but the master show nothing."""
    member = F.col("mr").isNotNull() & ~((F.col("mr") == F.col("row")) & (F.col("mc") == F.col("col")))
    return _with_master(cells, merges).select(*SHEET, "row", "col", F.when(member, F.lit("")).otherwise(F.col("display")).alias("display"))


def profile(cells: DataFrame, samples: int = 80, header_rows: int = 20, header_chars: int = 40) -> DataFrame:
    """Per sheet: cells, non-blank cells, sampled and header-like ones within their limits."""
    text = strip(F.coalesce("display", F.lit("")))
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row", "col"))
    full = cells.where(has_text(F.col("display"))).withColumn("place", place)
    heads = (F.col("row") <= header_rows) & (F.length(text) <= header_chars)
    counts = cells.groupBy(*SHEET).agg(F.count("*").alias("cells"), F.count_if(has_text(F.col("display"))).alias("non_blank"))
    more = full.groupBy(*SHEET).agg(F.count_if(F.col("place") <= samples).alias("sampled"), F.least(F.count_if(heads), F.lit(40)).alias("header_candidates"), F.min_by("display", "place").alias("first_text"))
    return counts.join(more, SHEET, "left").select(*SHEET, "cells", "non_blank", F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("header_candidates", F.lit(0)).alias("header_candidates"), "first_text")


def _islands(rows: DataFrame, keys: list[str], at: str, gap: int, breaks: Column | None = None) -> DataFrame:
    """rows with island numbers from 1: a new one where `at` jumps by more than gap, or breaks holds."""
    order = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(at).over(order)
    new = before.isNull() | (F.col(at) - before > gap)
    new = new if breaks is None else new | breaks
    return rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def numbered_rows(cells: DataFrame) -> DataFrame:
    """(doc, sheet, row, band): rows with text and the number of their run; a row with bold text begins a new one."""
    rows = cells.where(has_text(F.col("display"))).groupBy(*SHEET, "row").agg(F.bool_or(F.coalesce("bold", F.lit(False))).alias("heading"))
    return _islands(rows, SHEET, "row", 1, F.col("heading")).select(*SHEET, "row", F.col("island").alias("band"))


def row_bands(cells: DataFrame) -> DataFrame:
    """(doc, sheet, band, r0, r1): runs of rows with text; a row with bold text begins a new one."""
    return numbered_rows(cells).groupBy(*SHEET, "band").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))


def column_islands(cells: DataFrame) -> DataFrame:
    """(doc, sheet, band, island, r0, r1, c0, c1): inside each band, runs of columns with text."""
    full = cells.where(has_text(F.col("display"))).select(*SHEET, "row", "col").join(numbered_rows(cells), [*SHEET, "row"])
    columns = full.groupBy(*SHEET, "band", "col").agg(F.lit(1).alias("one")).join(row_bands(cells), [*SHEET, "band"]).drop("one")
    return _islands(columns, [*SHEET, "band"], "col", 1).groupBy(*SHEET, "band", "island", "r0", "r1").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))


def row_clusters(cells: DataFrame, tolerance: int = 2) -> DataFrame:
    rows = cells.where(has_text(F.col("display"))).select(*SHEET, "row").distinct()
    return _islands(rows, SHEET, "row", tolerance).groupBy(*SHEET, F.col("island").alias("cluster")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.count("*").alias("rows"))


def blank_run_cut(cells: DataFrame, run: int) -> DataFrame:
    """(doc, sheet, r0, r1): bounds that end before the first run of so many rows without text; one row at least."""
    box = bounds(cells)
    if run <= 0:
        return box.select(*SHEET, "r0", "r1")
    full = cells.where(has_text(F.col("display"))).select(*SHEET, "row").distinct()
    spine = box.select(*SHEET, "r0", "r1", F.explode(F.sequence("r0", "r1")).alias("row"))
    blank = spine.join(full, [*SHEET, "row"], "left_anti")
    streak = blank.withColumn("g", F.col("row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")))
    first = streak.groupBy(*SHEET, "g").agg(F.min("row").alias("at"), F.count("*").alias("n")).where(F.col("n") >= run).groupBy(*SHEET).agg(F.min("at").alias("at"))
    return box.join(first, SHEET, "left").select(*SHEET, "r0", F.greatest("r0", F.coalesce(F.col("at") - 1, F.col("r1"))).alias("r1"))


def shrink_to_content(cells: DataFrame) -> DataFrame:
    return bounds(cells.where(has_text(F.col("display"))), spans=True)


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Without the columns of a sheet that have no text, inner ones too."""
    return cells.join(cells.where(has_text(F.col("display"))).select(*SHEET, "col").distinct(), [*SHEET, "col"], "left_semi")


def header_labels(cells: DataFrame, first: int, rows: int) -> DataFrame:
    """(doc, sheet, col, label): the distinct texts of the header rows of a column, top down."""
    heads = cells.where(F.col("row").between(first, first + rows - 1) & has_text(F.col("display"))).select(*SHEET, "col", "row", strip(F.col("display")).alias("t"))
    once = heads.groupBy(*SHEET, "col", "t").agg(F.min("row").alias("row"))
    return once.groupBy(*SHEET, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]), " / ").alias("label"))


def dense_rows(cells: DataFrame) -> DataFrame:
    """(doc, sheet, row, texts): the texts of each row with any, one per column of the sheet's bounds."""
    grid = densify(cells)
    rows = grid.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("display", F.lit("")).alias("t")))).alias("x"))
    return rows.select(*SHEET, "row", F.transform("x", lambda x: x["t"]).alias("texts")).where(F.exists("texts", lambda t: strip(t) != ""))


def covered(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells inside a region (doc, sheet, r0, c0, r1, c1)."""
    boxes = regions.select(*[F.col(c).alias(f"g_{c}") for c in (*SHEET, "r0", "c0", "r1", "c1")])
    inside = (F.col("doc") == F.col("g_doc")) & (F.col("sheet") == F.col("g_sheet")) & F.col("row").between(F.col("g_r0"), F.col("g_r1")) & F.col("col").between(F.col("g_c0"), F.col("g_c1"))
    return cells.join(boxes, inside, "left_semi")


def uncovered(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells with text that no region holds."""
    boxes = regions.select(*[F.col(c).alias(f"g_{c}") for c in (*SHEET, "r0", "c0", "r1", "c1")])
    inside = (F.col("doc") == F.col("g_doc")) & (F.col("sheet") == F.col("g_sheet")) & F.col("row").between(F.col("g_r0"), F.col("g_r1")) & F.col("col").between(F.col("g_c0"), F.col("g_c1"))
    return cells.where(has_text(F.col("display"))).join(boxes, inside, "left_anti")


def label_values(cells: DataFrame, labels: list[str]) -> DataFrame:
    """(doc, sheet, row, col, label, value): a known label and the next text to its right, unless that is a label too."""
    known = {x.rstrip("：:").strip() for x in labels}
    full = cells.where(has_text(F.col("display"))).select(*SHEET, "row", "col", strip(F.col("display")).alias("t"))
    own = strip(F.regexp_replace("t", "[：:]+$", ""))
    right = Window.partitionBy(*SHEET, "row").orderBy("col")
    rows = full.withColumn("label", own).withColumn("value", F.lead("t").over(right)).withColumn("next", F.lead(own).over(right))
    return rows.where(F.col("label").isin(*known) & F.col("value").isNotNull() & ~F.col("next").isin(*known)).select(*SHEET, "row", "col", "label", "value")


def main_table_start(cells: DataFrame, hints: list[str], strong: tuple[str, ...] = ()) -> DataFrame:
    """(doc, sheet, start): the row where the main table begins; null where none is found.

    The first row that looks like a header (three cells or more, with a number
    column or a strong hint, or five with two of the hints); else, among the first 30 rows, one with
    so many cells that it stands out and a fuller row among the next three.
    """
    full = cells.where(has_text(F.col("display"))).select(*SHEET, "row", "col", strip(F.col("display")).alias("t"))
    hit = [F.bool_or(F.col("t").contains(h)).cast("int") for h in hints]
    hits = hit[0]
    for h in hit[1:]:
        hits = hits + h
    numbered = F.col("t").rlike(r"(?i)^No\.?$")
    for h in strong:
        numbered = numbered | F.col("t").contains(h)
    rows = full.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.bool_or(numbered).alias("numbered"), hits.alias("hits"))
    header = (F.col("n") >= 3) & (F.col("numbered") | ((F.col("n") >= 5) & (F.col("hits") >= 2)))
    top = bounds(cells).select(*SHEET, "r0")
    ordered = Window.partitionBy(*SHEET).orderBy("row").rangeBetween(1, 3)
    rows = rows.withColumn("header", header).withColumn("fuller", F.coalesce(F.max((F.col("n") >= 2).cast("int")).over(ordered), F.lit(0)) == 1).join(top, SHEET)
    early = rows.where(F.col("row") < F.col("r0") + 30)
    middle = early.groupBy(*SHEET).agg(F.array_sort(F.collect_list("n")).alias("ns")).select(*SHEET, F.greatest(F.lit(6), F.get("ns", F.floor(F.size("ns") / 2).cast("int")) + 3).alias("limit"))
    tall = early.join(middle, SHEET).where((F.col("n") >= F.col("limit")) & F.col("fuller")).groupBy(*SHEET).agg(F.min("row").alias("tall"))
    first = rows.groupBy(*SHEET).agg(F.min(F.when(F.col("header"), F.col("row"))).alias("head"))
    return first.join(tall, SHEET, "left").select(*SHEET, F.coalesce("head", "tall").alias("start"))
