"""Documents as canonical JSON and back, the schema's diagnostics, and templates by id and version."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.a1 import cell as address
from gridloom.functions.json_schema import violations
from gridloom.plans import views
from gridloom.sources import documents as d
from gridloom.sources.document_schema import DOCUMENT, TEMPLATE
from gridloom.sources.files import write_files

SF = "/root/testdata/sf0.001"
BOOK = {
    "document_id": "b1", "title": "T", "schema_version": "1.0", "template_id": "t", "source_path": "x/ü.xlsx", "metadata": {"z": [1, {"b": None, "a": 2.5}], "a": "é"},
    "assets": [{"asset_id": "p0", "asset_type": "image", "uri": "u"}], "diagnostics": [{"code": "c", "severity": "info", "message": "m", "details": {"k": [1]}}],
    "sheets": [
        {"sheet_id": "s0", "name": "S 0", "index": 0, "regions": [
            {"region_id": "r0", "region_type": "table", "title": "R", "source": {"sheet": "S 0", "range": "A1:B2"}, "confidence": 0.5, "values": {"k": "v", "n": 3}, "asset_ids": ["p1"],
             "tables": [{"table_id": "t0", "header_rows": 1, "column_semantics": {"B": "two", "A": "one"}, "source": {"sheet": "S 0"}, "cells": [
                 {"coordinate": "A1", "row": 1, "column": 1, "raw_value": 12.5, "display_value": " 12.50 ", "data_type": "number", "formula": "=B1", "style": {"font": {"bold": True}}, "row_span": 2},
                 {"coordinate": "B1", "row": 1, "column": 2, "raw_value": True, "data_type": "boolean"}, {"coordinate": "AA2", "row": 2, "column": 27, "raw_value": {"y": 1, "x": "\"q\"\n"}, "merged_master": "A1"}]},
                {"table_id": "t1"}]},
            {"region_id": "r1", "region_type": "freeform"}],
         "assets": [{"asset_id": "p1", "asset_type": "chart", "uri": "v", "anchor": "B2", "source": {"sheet": "S 0", "cell": "B2"}, "metadata": {"w": 1}}]},
        {"sheet_id": "s1", "name": "", "index": 1, "diagnostics": [{"code": "e", "severity": "error", "message": "", "region_id": "r9", "source": {"sheet": "x"}}]}],
}


def plain(value):
    """Sorted, without nulls, empty objects and lists, header_rows of 0 and spans of 1; lists of sheets, regions, tables and cells stay."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def filled(book):
    for s in book["sheets"]:
        s.setdefault("regions", [])
        for r in s["regions"]:
            for t in r.setdefault("tables", []):
                t.setdefault("cells", [])
    return book


def as_json(rows):
    return "".join(r["content"] for r in rows.orderBy("ord").collect())


def values(spark, *books):
    return spark.createDataFrame([(b["document_id"] if isinstance(b, dict) else f"bad{i}", json.dumps(b) if isinstance(b, dict) else b) for i, b in enumerate(books)], "doc string, t string").select("doc", F.try_parse_json("t").alias("value"))


def test_canonical_json_of_a_whole_book(spark):
    assert as_json(d.canonical(d.parts_of(values(spark, BOOK)))) == plain(filled(json.loads(json.dumps(BOOK)))) + "\n"


def relations(spark, cells):
    """Documents of the customers' sheets, one table a sheet."""
    own = cells.withColumn("idx", F.dense_rank().over(Window.partitionBy("doc").orderBy("sheet")) - 1)
    sheets = own.groupBy("doc", "idx").agg(F.first("sheet").alias("name")).select("doc", "idx", F.concat(F.lit("s"), "idx").alias("sheet_id"), "name", F.lit(None).cast("variant").alias("metadata"))
    none = F.lit(None)
    regions = sheets.select("doc", "idx", F.lit(0).alias("ord"), F.lit("r").alias("region_id"), F.lit("table").alias("region_type"), none.cast("string").alias("title"), F.col("name").alias("sheet"), F.lit("A1:F9").alias("range"), none.cast("variant").alias("values"), F.array().cast("array<string>").alias("asset_ids"), F.lit(1.0).alias("confidence"), none.cast("variant").alias("metadata"))
    tables = sheets.select("doc", "idx", F.lit(0).alias("ord"), F.lit(0).alias("n"), F.lit("t").alias("table_id"), F.col("name").alias("sheet"), none.cast("string").alias("range"), F.lit(1).alias("header_rows"), F.create_map(F.lit("B"), F.lit("nation"), F.lit("A"), F.lit("name")).alias("column_semantics"), none.cast("variant").alias("metadata"))
    kind = F.when(F.col("display").rlike(r"^-?\d+$"), "number").otherwise("string")
    full = own.select("doc", "idx", F.lit(0).alias("ord"), F.lit(0).alias("n"), "row", "col", d.raw_value(kind, F.col("display")).alias("raw"), "display", kind.alias("data_type"), none.cast("string").alias("formula"), F.when(F.col("bold"), F.parse_json(F.lit('{"font":{"bold":true}}'))).alias("style"), none.cast("string").alias("merged_master"), F.lit(1).alias("row_span"), (F.col("row") % 2 + 1).cast("int").alias("col_span"))
    heads = own.select("doc").distinct().select("doc", F.col("doc").alias("title"), none.cast("string").alias("source_path"), F.lit("t").alias("template_id"), none.cast("string").alias("template_version"), none.cast("variant").alias("metadata"))
    return d.Parts(heads, sheets, regions, tables, full, d.empty(spark, "assets"), d.empty(spark, "diagnostics"))


def shown(df):
    text = [F.to_json(c).alias(c) if kind == "variant" else F.to_json(F.parse_json(F.to_json(c))).alias(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
    return sorted(map(repr, map(tuple, df.select(*[text[i] for i in sorted(range(len(text)), key=lambda i: df.columns[i])]).collect())))


def test_files_read_back_equal_every_relation(spark, tmp_path):
    parts = relations(spark, views.cells(spark, SF))
    rows = d.canonical(parts)
    write_files(rows.select(F.concat("doc", F.lit(".json")).alias("file"), "ord", "content"), str(tmp_path), "ord", bom=True)
    again = d.read(spark, str(tmp_path))
    assert again.where("value IS NULL").count() == 0
    back = d.parts_of(again.select("doc", "value"))
    for name in d.SCHEMAS:
        assert shown(getattr(back, name)) == shown(getattr(parts, name)), name
    assert shown(back.cells) and shown(back.sheets)
    assert d.schema_diagnostics(again.select("doc", "value")).count() == 0
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, d.canonical(back).collect()))


def test_schema_diagnostics_name_sheet_and_region(spark):
    bad = json.loads(json.dumps(BOOK))
    bad |= {"document_id": "b2", "extra": 1, "schema_version": "2"}
    bad["sheets"][0]["regions"][0]["tables"][0]["cells"][1] |= {"row": 0, "coordinate": "b1"}
    bad["sheets"][0]["regions"][1]["region_type"] = "other"
    del bad["sheets"][1]["sheet_id"]
    rows = d.schema_diagnostics(values(spark, BOOK, bad, "{no json")).collect()
    got = sorted((r["location"], r["keyword"], r["message"].split(": ", 1)[1], r["sheet"], r["region_id"]) for r in rows if r["doc"] == "b2")
    want = [(".".join(p) or "$", k, m) for p, k, m in violations(DOCUMENT, bad)]
    assert [x[:3] for x in got] == sorted(want) and len(got) == 6
    assert {(x[0], x[3], x[4]) for x in got} >= {("sheets.0.regions.0.tables.0.cells.1.row", "S 0", "r0"), ("sheets.0.regions.1.region_type", "S 0", "r1"), ("sheets.1", "", None), ("$", None, None)}
    assert [(r["doc"], r["code"]) for r in rows if r["doc"] != "b2"] == [("bad2", "document.unreadable")]


def test_templates_by_id_and_version(spark):
    heads = spark.createDataFrame([("a", "t", None), ("b", "t", "1.9"), ("c", "t", "3"), ("d", "u", None), ("e", None, None)], "doc string, template_id string, template_version string")
    templates = spark.createDataFrame([("t", "1.9"), ("t", "1.10"), ("t", "1.2"), ("v", "1")], "template_id string, version string")
    got = {r["doc"]: (r["template_id"], r["version"]) for r in d.template_of_documents(heads, templates).collect()}
    assert got == {"a": ("t", "1.10"), "b": ("t", "1.9"), "c": (None, None), "d": (None, None), "e": (None, None)}


def test_raw_values_keep_their_types(spark):
    rows = [("number", "12.50"), ("number", "1e3"), ("number", "0x1"), ("boolean", "TRUE"), ("string", "12"), ("date", "2024-01-02"), ("duration", "25:01:02.5"), ("number", None), ("string", 'q"\n')]
    df = spark.createDataFrame(rows, "k string, t string").select(d.raw_value(F.col("k"), F.col("t")).alias("v"))
    got = [r[0] for r in df.select(F.to_json("v")).collect()]
    assert [None if x is None else json.loads(x) for x in got] == [12.5, 1000, "0x1", True, "12", "2024-01-02", 90062.5, None, 'q"\n']
    texts = df.select(d.stringify(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in texts][3:6] == ["true", "12", "2024-01-02"] and texts[7]["s"] == ""


def test_template_schema_tells_what_is_wrong():
    region = {"region_id": "r", "region_type": "weird", "locator": {"mode": "fixed", "range": "A1:Z"}, "extractor": {"kind": "table", "header_rows": -1}}
    template = {"schema_version": "1.0", "template_id": "t", "version": "1", "name": "n", "sheets": [{"sheet_id": "s", "name_pattern": "x", "regions": [region, {**region, "locator": {"mode": "anchor"}, "region_type": "table"}]}], "match": {"fingerprints": [{"cells": {"$A$1": "x"}}, {"weight": 0}]}}
    keywords = {(".".join(p), k) for p, k, _ in violations(TEMPLATE, template)}
    at = "sheets.0.regions.0"
    assert keywords == {
        (f"{at}.region_type", "enum"), (f"{at}.locator.range", "pattern"), (f"{at}.extractor.header_rows", "minimum"), ("sheets.0.regions.1.locator", "anyOf"), ("sheets.0.regions.1.extractor.header_rows", "minimum"),
        ("match.fingerprints.0.cells", "propertyNames"), ("match.fingerprints.1", "anyOf"), ("match.fingerprints.1.weight", "exclusiveMinimum"),
    }


def test_addresses_are_the_schemas_own(spark):
    assert spark.range(1).select(address(F.lit(2), F.lit(27)).alias("a")).first()["a"] == "AA2"
