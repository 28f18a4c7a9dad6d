"""Readable documents: each table in the form that fits it, layouts by row, assets once."""

import re

import pytest
from test_document_rules import book, parts

from gridloom.operators import business


def cell(row, col, text=None, **more):
    return {"coordinate": f"{'ABCDEF'[col - 1]}{row}", "row": row, "column": col, **({"display_value": text} if text is not None else {}), **more}


MEANT = {"table_id": "t0", "header_rows": 2, "column_semantics": {"A": "id", "C": "name", "D": "needed"}, "metadata": {"header_labels": {"A": "Item / ID", "C": "Item / Name", "D": "Needed"}}, "cells": [
    cell(1, 1, "Item", col_span=3), cell(1, 4, "Needed"), cell(2, 1, "ID"), cell(2, 3, "Name"), cell(3, 1, "001"), cell(3, 2, "hidden"), cell(3, 3, "a|b"), cell(3, 4, "yes\nno"),
    cell(4, 1, "both", col_span=3), cell(4, 2, merged_master="A4"), cell(4, 3, merged_master="A4"), cell(4, 4, "no"), cell(5, 1, ""), cell(6, 1, "Group: one", col_span=4)]}
MERGED = {"table_id": "t1", "header_rows": 1, "cells": [cell(1, 1, "H <1>", col_span=2), cell(1, 2, merged_master="A1"), cell(2, 1, "x", row_span=2), cell(2, 2, "y"), cell(3, 1, merged_master="A2"), cell(3, 2, "z")]}
GRID = {"table_id": "t2", "header_rows": 1, "cells": [cell(1, 1, "Key"), cell(1, 2, "Value"), cell(2, 1, "A|B"), cell(2, 2, raw_value=12), cell(3, 1, ""), cell(4, 2, "end")]}
LISTED = {"table_id": "t3", "cells": [cell(1, 1, "Title", col_span=2), cell(1, 2, merged_master="A1"), cell(1, 3, "v1"), cell(3, 1, " "), cell(4, 2, "line")]}
NOTES = {"table_id": "t4", "cells": [cell(2, 1, "above"), cell(3, 1, "still above"), cell(10, 1, "below")]}
ASSETS = [
    {"asset_id": "p1", "asset_type": "image", "uri": "/out/img/one.png", "description": "one", "anchor": "B3:C9"}, {"asset_id": "p2", "asset_type": "shape", "uri": "https://x/two"},
    {"asset_id": "p3", "asset_type": "chart", "uri": "three.png"}, {"asset_id": "p4", "asset_type": "screenshot", "uri": "four.png", "metadata": {"source_kind": "region_screenshot"}}, {"asset_id": "p5", "asset_type": "image", "uri": "five.png"},
]
BOOK = book("a",
    {"sheet_id": "Screen!", "name": "First", "index": 0, "assets": ASSETS, "regions": [
        {"region_id": "r0", "region_type": "table", "title": "Tables", "tables": [MEANT, MERGED, GRID, {"table_id": "none", "header_rows": 1, "cells": [cell(1, 1, "only a header")]}], "asset_ids": ["p2", "gone"]},
        {"region_id": "cover", "region_type": "freeform", "title": "", "values": {"owner": "me", "none": "", "size": 3}, "metadata": {"value_labels": {"owner": "Owner"}, "key_labels": {"How large": "size", "x": "owner"}}, "tables": [LISTED]},
        {"region_id": "unrecognized-1", "region_type": "freeform", "tables": [LISTED]}, {"region_id": "blank", "region_type": "freeform"},
        {"region_id": "mock", "region_type": "layout", "tables": [NOTES], "asset_ids": ["p1", "p2", "p3", "p5"]},
        {"region_id": "shot", "region_type": "table", "metadata": {"readable_mode": "screenshot"}, "tables": [GRID], "asset_ids": ["p5", "p4"]}]},
    {"sheet_id": "", "name": "Second", "index": 1, "regions": []})

MARKDOWN = """# 

## First

### Tables

#### t0

| Item / ID | Item / Name | Needed |
| --- | --- | --- |
| 001 | a\\|b | yes<br>no |
| both | both | no |
| **Group: one** |  |  |

#### t1

<table class="sheet-table">
  <tr>
    <th colspan="2" data-source-cell="A1">H &lt;1&gt;</th>
  </tr>
  <tr>
    <td rowspan="2" data-source-cell="A2">x</td>
    <td data-source-cell="B2">y</td>
  </tr>
  <tr>
    <td data-source-cell="B3">z</td>
  </tr>
</table>

#### t2

| Key | Value |
| --- | --- |
| A\\|B | 12 |
|  | end |

[p2](https://x/two)

- **Owner**: me
- **How large**: 3

- Title / v1
-  
- line

### mock

- above

- still above

![one](img/one.png)

- below

![p3](three.png)

![p5](five.png)

### shot

![four](four.png)

## Second

"""


@pytest.fixture(scope="module")
def relations(spark):
    return parts(spark, BOOK)


def text(df):
    return "".join(r["content"] for r in df.orderBy("ord").collect())


def test_markdown(spark, relations):
    assert text(business.markdown(relations, "/out")) == MARKDOWN.replace("![four]", "![p4]")


def test_html(spark, relations):
    page = text(business.html(relations, "/out"))
    assert page.startswith("<!doctype html>") and page.endswith("</html>\n")
    assert '<section id="sheet-0-screen"><h2>First</h2>' in page and '<section id="sheet-1-1">' in page and '<li><a href="#sheet-0-screen-region-0-r0">Tables</a></li>' in page
    assert '<table><tr><th>Item / ID</th><th>Item / Name</th><th>Needed</th></tr><tr><td>001</td><td>a|b</td><td>yes\nno</td></tr><tr><td>both</td><td>both</td><td>no</td></tr><tr><td colspan="3"><strong>Group: one</strong></td></tr></table>' in page
    assert "<ul><li>Title / v1</li>" in page and '<dl class="metadata"><dt>Owner</dt><dd>me</dd><dt>How large</dt><dd>3</dd></dl>' in page
    assert page.index("<p>still above</p>") < page.index('<img src="img/one.png"') < page.index("<p>below</p>") < page.index('<img src="three.png"') < page.index('<img src="five.png"')
    assert page.count("<section") == page.count("</section>") == 6 and page.count("four.png") == 1 and "unrecognized" not in page
    assert len(re.findall(r'rowspan="2"', page)) == 1 and page.count("<td data-source-cell") == 2 + 4  # the grid is shown with its cells too


def test_documents_without_anything(spark):
    empty = parts(spark, book("b"))
    assert text(business.markdown(empty)) == "# \n\n" and "<main><h1></h1></main>" in text(business.html(empty))
