"""Rules over documents: paths, scopes, severities and messages, held against cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators.document_rules import RegionRules, Rule, RuleSet, SheetRules, diagnostics, field_values
from gridloom.sources import documents as d


def table(columns, rows, header=1):
    cells = [{"coordinate": f"{'ABC'[j]}{i + 1}", "row": i + 1, "column": j + 1, **({"raw_value": v} if v is not None else {})} for i, r in enumerate(rows) for j, v in enumerate(r)]
    return {"table_id": "t", "header_rows": header, "column_semantics": columns, "cells": cells}


def sheet(i, sheet_id, name, *regions):
    return {"sheet_id": sheet_id, "name": name, "index": i, "regions": [{"region_type": "table", **r} for r in regions]}


def book(doc, *sheets):
    return {"document_id": doc, "title": "", "schema_version": "1.0", "sheets": list(sheets)}


ITEMS = table({"A": "id", "B": "state", "C": "note"}, [["Id", "State", "Note"], ["x1", 1, None], ["x2", "1", " "], ["x1", 2, "n"], ["bad", True, "n"]])
USES = table({"A": "id"}, [["Id"], ["x1"], ["x9"], [1]])
FIRST = book("a", sheet(0, "s0", "Items 2024", {"region_id": "list", "tables": [ITEMS]}, {"region_id": "head", "region_type": "key_value", "values": {"owner": "", "size": 3, "x.y": "dotted"}}), sheet(1, "USES", "other", {"region_id": "u", "tables": [USES]}))
SECOND = book("b", sheet(0, "z", "uses", {"region_id": "u", "tables": [table({"A": "id"}, [["Id"]])]}))


def parts(spark, *books):
    rows = spark.createDataFrame([(b["document_id"], json.dumps(b)) for b in books], "doc string, t string").select("doc", F.parse_json("t").alias("value"))
    return d.parts_of(rows)


def told(spark, rules, *books):
    return sorted(((r["doc"], r["rule_id"], r["code"].split(".")[1], r["severity"], r["sheet"], r["region_id"], r["value"], r["n"]) for r in diagnostics(parts(spark, *books), rules).collect()), key=str)


def test_values_of_fields(spark):
    got = sorted((r["doc"], r["field"], r["v"]) for r in field_values(parts(spark, FIRST, SECOND)).select("doc", "field", F.coalesce(F.to_json("value"), F.lit("-")).alias("v")).collect())
    assert [x for x in got if x[1] in ("owner", "size", "x.y")] == [("a", "owner", '""'), ("a", "size", "3"), ("a", "x.y", '"dotted"')]
    assert [x[2] for x in got if x[:2] == ("a", "state")] == ['"1"', "1", "2", "true"] and ("b", "id", "-") in got


def test_rules_by_region_and_document(spark):
    rules = RuleSet(
        (
            SheetRules("items", "^items", True, (RegionRules("list", True, (
                Rule("r1", "required", "note", "warning"), Rule("r2", "required", "absent"), Rule("r3", "unique", "id", "info"), Rule("r4", "enum", "state", options={"values": [1, 2]}), Rule("r5", "regex", "id", options={"pattern": r"^x\d$"}),
                Rule("r6", "regex", "id", options={"pattern": "("}), Rule("r7", "regex", "id"), Rule("r8", "reference", "id", options={"target": "uses.u.id"}),
            )), RegionRules("gone", True), RegionRules("maybe", False, (Rule("r9", "required", "x"),)))),
            SheetRules("extra", "extra", False, (RegionRules("e", True, (Rule("s1", "required", "x"),)),)),
        ),
        (Rule("d1", "required", "items.head.owner"), Rule("d2", "required", "ITEMS 2024.head.size"), Rule("d3", "required", "uses.u.id", message="ids please"), Rule("d4", "required", "extra.e.x"), Rule("d5", "required", "nowhere.e.x", "odd"), Rule("d6", "required", "short.path"),
         Rule("d7", "required", "items.head.x.y"), Rule("d8", "reference", "uses.u.id", options={"target_field": "items.list.id"})),
    )
    name = "Items 2024"
    inside = lambda rule, kind, severity, value, n: ("a", rule, kind, severity, name, "list", value, n)
    got = told(spark, rules, FIRST, SECOND)
    assert got == sorted([
        inside("r1", "required", "warning", None, 2), inside("r2", "required", "error", None, 1), inside("r3", "unique", "info", "x1", 2), inside("r4", "enum", "error", "1", 1), inside("r4", "enum", "error", "true", 1),
        inside("r5", "regex", "error", "bad", 1), inside("r6", "regex", "error", "(", 1), inside("r7", "regex", "error", None, 1), inside("r8", "reference", "error", "x2", 1), inside("r8", "reference", "error", "bad", 1),
        ("a", "required_region", "required_region", "error", name, "gone", None, 1), ("b", "required_sheet", "required_sheet", "error", None, None, None, 1),
        ("a", "d1", "required", "error", name, "head", None, 1), ("b", "d2", "required", "error", None, "head", None, 1), ("b", "d3", "required", "error", "uses", "u", None, 1),
        ("a", "d5", "required", "error", None, "e", None, 1), ("b", "d5", "required", "error", None, "e", None, 1), ("a", "d6", "required", "error", None, None, None, 1), ("b", "d6", "required", "error", None, None, None, 1),
        ("a", "d8", "reference", "error", "other", "u", "1", 1), ("a", "d8", "reference", "error", "other", "u", "x9", 1), ("b", "d8", "reference", "error", "uses", "u", "items.list.id", 1),
    ], key=str)
    messages = {r["rule_id"]: r["message"] for r in diagnostics(parts(spark, FIRST, SECOND), rules).collect()}
    assert messages["d3"] == "ids please" and messages["r2"] == "no field or column absent"


def test_an_alias_goes_before_a_name(spark):
    """`uses` is the id of one sheet and the alias of another."""
    rules = RuleSet((SheetRules("uses", "^items"),), (Rule("d", "unique", "uses.list.id"), Rule("e", "unique", "other.u.id")))
    assert told(spark, rules, FIRST) == [("a", "d", "unique", "error", "Items 2024", "list", "x1", 2)]


def test_no_rules_and_wrong_kinds(spark):
    assert told(spark, RuleSet(), FIRST) == []
    with pytest.raises(ValueError, match="no kind"):
        diagnostics(parts(spark, FIRST), RuleSet(rules=(Rule("x", "dance"),)))


def test_templates_give_rules():
    from test_templates import GOOD

    from gridloom.sources.templates import problems, rules_of

    region = {**GOOD["sheets"][0]["regions"][0], "required": True, "validation_rules": [{"rule_id": "r", "kind": "regex", "field": "id", "severity": "info", "options": {"pattern": "x"}}]}
    data = {**GOOD, "sheets": [{**GOOD["sheets"][0], "regions": [region], "required": False}], "validation_rules": [{"rule_id": "d", "kind": "required", "field": "s.r.id", "message": "m"}]}
    assert problems(data) == []
    assert rules_of(data) == RuleSet((SheetRules("s", "^A$", False, (RegionRules("r", True, (Rule("r", "regex", "id", "info", None, {"pattern": "x"}),)),)),), (Rule("d", "required", "s.r.id", "error", "m"),))
