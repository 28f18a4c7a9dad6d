"""Whole region extraction on small sheets."""

from gridloom.operators import regions
from gridloom.operators.template import Region
from gridloom.sources.templates import sheets_of


def grid(spark, *rows, sheet="S", merges=()):
    """Cells of one sheet; None is an absent cell."""
    cells = [("d", sheet, i, j, t, False) for i, row in enumerate(rows, 1) for j, t in enumerate(row, 1) if t is not None]
    return spark.createDataFrame(cells, "doc string, sheet string, row int, col int, display string, bold boolean"), spark.createDataFrame([("d", sheet, *m) for m in merges], "doc string, sheet string, r0 int, c0 int, r1 int, c1 int")


def held(cells, merges, *own):
    sheets = (regions.Sheet("s", "S", own),)
    boxes = regions.located(cells, sheets)
    return sheets, boxes, regions.members(cells, merges, boxes, sheets)


def corners(cells, merges, *own):
    sheets, boxes, rows = held(cells, merges, *own)
    return {r["region"]: tuple(r[c] for c in regions.CORNERS) for r in regions.regions(boxes, rows, sheets).collect()}


def test_table_ends_before_blank_rows_and_drops_empty_columns(spark):
    cells, merges = grid(spark, ("", "Top", "", "Size"), ("", "a", "", "1"), ("", "", "", ""), ("", "b", "", "2"), ("", "", "", ""), ("", "", "", ""), ("", "late", "", ""))
    region = Region("t", range=(1, 1, 7, 4), stop_after=2)
    assert corners(cells, merges, region) == {"t": (1, 2, 4, 4)}
    sheets, _, rows = held(cells, merges, region)
    assert {r["col"] for r in rows.collect()} == {2, 4}
    assert [(r["col"], r["label"]) for r in regions.columns(rows, sheets).orderBy("col").collect()] == [(2, "Top"), (3, ""), (4, "Size")]


def test_a_merge_master_counts_only_inside_the_region(spark):
    cells, merges = grid(spark, ("head", ""), ("", ""), ("x", "y"), merges=[(1, 1, 2, 2)])
    assert corners(cells, merges, Region("all", range=(1, 1, 3, 2), stop_after=1)) == {"all": (1, 1, 3, 2)}
    assert corners(cells, merges, Region("low", range=(2, 1, 3, 2), stop_after=1)) == {"low": (2, 1, 2, 2)}


def test_repeats_ends_and_titles(spark):
    cells, merges = grid(spark, ("Item", "1"), ("x", ""), ("End", ""), ("Item", "2"), ("y", ""))
    region = Region("r", kind="freeform", title="T", anchor_text="Item", end_pattern="^end$", repeat=True)
    sheets, boxes, rows = held(cells, merges, region)
    found = {(r["region"], r["title"], *[r[c] for c in regions.CORNERS]) for r in regions.regions(boxes, rows, sheets).collect()}
    assert found == {("r", "T", 1, 1, 2, 2), ("r-2", "T (2)", 4, 1, 5, 2)}
    left = regions.leftover(cells, regions.regions(boxes, rows, sheets), sheets).collect()
    assert {(r["region"], r["r0"], r["c0"], r["r1"], r["c1"], r["cells"]) for r in left} == {("unrecognized-1", 3, 1, 3, 1, 1), ("unrecognized-grid-residual", 3, 2, 3, 2, 1)}


def test_pairs_shrink_and_the_last_of_equal_names_wins(spark):
    cells, merges = grid(spark, ("", "", ""), ("", "Name", "A"), ("", "", "no key"), ("", "Date", ""), ("", "name", "B"), ("", "Gone", None))
    region = Region("p", kind="key_value", range=(1, 1, 6, 3), header_rows=0, shrink=True, keys=(("name", "who"),))
    sheets, _, rows = held(cells, merges, region)
    assert {(r["name"], r["value"]) for r in regions.pairs(rows, sheets).collect()} == {("who", "B"), ("Date", ""), ("Gone", None)}
    assert corners(cells, merges, region) == {"p": (2, 2, 6, 3)}


def test_regions_without_cells_or_anchor(spark):
    cells, merges = grid(spark, ("a",))
    own = (Region("far", range=(5, 5, 9, 9), stop_after=2), Region("needed", anchor_text="no", required=True), Region("nice", anchor_text="no"))
    assert corners(cells, merges, *own) == {"far": (5, 5, 5, 9)}
    sheets = (regions.Sheet("s", "S", own), regions.Sheet("gone", "^Z$"), regions.Sheet("free", "^Z$", required=False))
    found = regions.not_found(cells, regions.located(cells, sheets), sheets).collect()
    assert {(r["code"], r["severity"], r["name"]) for r in found} == {("template.region_not_found", "error", "needed"), ("template.region_not_found", "warning", "nice"), ("business.required_sheet", "error", "gone")}


def test_an_ignored_region_takes_its_cells_and_an_empty_table_gives_none(spark):
    cells, merges = grid(spark, ("a", "b"))
    sheets, boxes, rows = held(cells, merges, Region("i", kind="freeform", range=(1, 1, 1, 1), ignore=True))
    found = regions.regions(boxes, rows, sheets)
    assert [r["ignore"] for r in found.collect()] == [True]
    assert [(r["region"], r["c0"]) for r in regions.leftover(cells, found, sheets).collect()] == [("unrecognized-1", 2)]
    none = cells.where("false")
    sheets, boxes, rows = held(none, merges, Region("i", anchor_text="a"))
    assert regions.regions(boxes, rows, sheets).count() == 0 == regions.leftover(none, found, sheets).count()


def test_settings_come_from_a_mapping():
    extractor = {"kind": "table", "header_rows": 2, "column_semantics": {"A": "x"}, "options": {"stop_after_blank_rows": "3", "shrink_to_content": "yes", "trim_empty_columns": False}}
    region = {"region_id": "r", "region_type": "freeform", "required": True, "locator": {"mode": "anchor", "anchor_text": "a", "end_anchor_pattern": "^b"}, "extractor": extractor}
    (sheet,) = sheets_of({"sheets": [{"sheet_id": "s", "name_pattern": "S", "required": False, "regions": [region, {"region_id": "plain", "region_type": "asset", "locator": {"mode": "fixed", "range": "A1"}}]}]})
    one, plain = sheet.regions
    assert (one.kind, one.header_rows, one.stop_after, one.shrink, one.trim, one.required, one.end_pattern, one.columns) == ("table", 2, 3, True, False, True, "^b", (("A", "x"),))
    assert (plain.kind, plain.header_rows, plain.range) == ("asset", 0, (1, 1, 1, 1)) and not sheet.required
