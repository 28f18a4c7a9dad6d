"""The workbook data source: what is found, one reading for all relations, and broken parts as diagnostics."""

import json
import zipfile

import pytest
from test_sources import MAIN, workbook  # noqa: I001

from gridloom.sources import workbooks, xlsx


def rewrite(path, **changes):
    """The workbook of test_sources with some of its parts replaced."""
    workbook(path)
    with zipfile.ZipFile(path) as book:
        parts = {n: book.read(n) for n in book.namelist()}
    with zipfile.ZipFile(path, "w") as book:
        for n, content in (parts | {k: v for k, v in changes.items()}).items():
            book.writestr(n, content)


def test_files_are_found_once_in_order(tmp_path):
    for name in ("b.xlsx", "A.xlsm", "deep/c.XLTX", "deep/~$c.xlsx", "d.txt", "e.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    short = lambda found: [p.removeprefix(f"{tmp_path}/") for p, _ in found]
    assert short(workbooks.discover([str(tmp_path), str(tmp_path / "deep"), str(tmp_path / "b.xlsx")])) == ["A.xlsm", "b.xlsx", "deep/c.XLTX"]
    assert short(workbooks.discover([str(tmp_path)], json=True)) == ["A.xlsm", "b.xlsx", "deep/c.XLTX", "e.json"]
    assert [p for p, _ in workbooks.discover([f"file://{tmp_path}/deep"])] == [f"file://{tmp_path}/deep/c.XLTX"]
    assert workbooks.discover([str(tmp_path / "d.txt")]) == []
    with pytest.raises(FileNotFoundError):
        workbooks.discover([str(tmp_path / "none")])


def test_files_are_dealt_by_size():
    assert workbooks.dealt([("a", 3), ("b", 4), ("c", 4), ("d", 90), ("e", 1)], 8) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert workbooks.dealt([], 8) == []


def test_one_reading_gives_all_relations(spark, tmp_path):
    for i in range(3):
        workbook(tmp_path / f"book{i}.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got = workbooks.load(spark, str(tmp_path / "kept"), str(tmp_path))
    files = xlsx.scan(spark, str(tmp_path))
    for name, other in (("cells", xlsx.cells), ("merges", xlsx.merges), ("assets", xlsx.assets), ("texts", xlsx.drawing_texts), ("diagnostics", xlsx.diagnostics)):
        df = getattr(got, name)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan.lower() and "BatchScan" not in plan  # the files are not read again
        bare = lambda rows: sorted(repr((str(r[0]).removeprefix("file:").lstrip("/"), *r[1:])) for r in rows)
        assert bare(df.collect()) == bare(other(files).collect()) and df.count() > 0, name
    (tmp_path / "book0.xlsx").unlink()
    assert got.cells.select("doc").distinct().count() == 3
    assert workbooks.rows(spark, str(tmp_path), most=1).rdd.getNumPartitions() == 3


def test_broken_cells_and_parts_are_diagnostics(spark, tmp_path):
    sheet = f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>99</v></c><c r="B1"><v>12x</v></c><c><v>7</v></c><c r="D1" s="77"><v>1</v></c></row><row><c><v>8</v></c></row></sheetData><mergeCells><mergeCell ref="A3:XFD1048576"/><mergeCell ref="$A$1"/></mergeCells></worksheet>'
    rewrite(tmp_path / "cells.xlsx", **{"xl/worksheets/sheet1.xml": sheet})
    rewrite(tmp_path / "xml.xlsx", **{"xl/worksheets/sheet1.xml": "<worksheet", "xl/sharedStrings.xml": "<sst"})
    rewrite(tmp_path / "draw.xlsx", **{"xl/drawings/drawing1.xml": "<x"})
    rewrite(tmp_path / "root.xlsx", **{"xl/workbook.xml": "<x"})
    got = workbooks.load(spark, str(tmp_path / "kept"), str(tmp_path))
    codes = {}
    for r in got.diagnostics.collect():
        codes.setdefault(r["doc"].rpartition("/")[2], []).append((r["code"], r["cell"]))
    lost = ("sheet.part-missing", None)
    assert sorted(codes["cells.xlsx"], key=str) == sorted([("cell.number-invalid", "B1"), ("cell.string-missing", "A1"), ("merge.invalid", None), lost], key=str)
    assert sorted(codes["xml.xlsx"]) == [lost, ("sheet.unreadable", None), ("workbook.strings-unreadable", None)]
    assert sorted(codes["draw.xlsx"]) == [("drawing.unreadable", None), lost] and codes["root.xlsx"] == [("workbook.unreadable", None)]
    cells = {(r["row"], r["col"]): r["display"] for r in got.cells.where("doc LIKE '%cells.xlsx'").collect()}
    assert cells == {(1, 1): None, (1, 2): "12x", (1, 3): "7", (1, 4): "1", (2, 1): "8"}
    assert got.merges.where("doc LIKE '%cells.xlsx'").count() == 1


def test_styles_tell_what_is_not_plain(tmp_path):
    styles = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="0.0%"/></numFmts>
<fonts><font><name val="Arial"/></font><font><b/><i val="0"/><u/><sz val="12"/><color rgb="FFFF0000"/><name val="Arial"/></font></fonts>
<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor theme="3" tint="-0.5"/></patternFill></fill></fills>
<borders><border><left/></border><border><left style="thin"><color indexed="64"/></left><top style="thick"/></border></borders>
<cellXfs><xf/><xf fontId="1" fillId="1" borderId="1" numFmtId="170"><alignment horizontal="center" wrapText="1"/></xf></cellXfs></styleSheet>"""
    rewrite(tmp_path / "s.xlsx", **{"xl/styles.xml": styles})
    rows = [r for part, r in xlsx.rows_of("s", (tmp_path / "s.xlsx").read_bytes()) if part == "cell"]
    (title,) = [r for r in rows if r[2:4] == (1, 1)]
    assert title[8] is True and json.loads(title[12]) == {
        "alignment": {"horizontal": "center", "wrapText": "1"}, "border": {"left": {"color": {"indexed": 64}, "style": "thin"}, "top": {"style": "thick"}},
        "fill": {"foreground": {"theme": 3, "tint": -0.5}, "pattern": "solid"}, "font": {"bold": True, "color": {"rgb": "FFFF0000"}, "name": "Arial", "size": 12.0, "underline": "single"}, "number_format": "0.0%",
    }
    assert [json.loads(r[12]) for r in rows if r[2:4] == (1, 2)] == [{"font": {"name": "Arial"}}]


def test_texts_of_drawings_once_first_seen_first(tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as _:
        pass
    workbook(tmp_path / "b.xlsx")
    with zipfile.ZipFile(tmp_path / "b.xlsx") as book:
        drawing = book.read("xl/drawings/drawing1.xml").decode()
    shape = drawing[drawing.index("<xdr:twoCellAnchor>") : drawing.index("</xdr:twoCellAnchor>") + len("</xdr:twoCellAnchor>")]
    more = drawing.replace("</xdr:wsDr>", shape + shape.replace("first", "other") + "</xdr:wsDr>")
    rewrite(tmp_path / "b.xlsx", **{"xl/drawings/drawing1.xml": more})
    texts = [r[2:] for part, r in xlsx.rows_of("b", (tmp_path / "b.xlsx").read_bytes()) if part == "text"]
    assert texts == [(0, "first\nsecond"), (1, "other\nsecond")]
