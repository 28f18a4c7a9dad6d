"""Lossless documents: relations to canonical JSON and back, and the schema's diagnostics.

A document's parts are relations: sheets, regions, tables, cells, assets, diagnostics.
Canonical JSON has sorted keys at every depth, no nulls and a line end; it is written
in pieces, one for each cell, so a document may be larger than a value or a task's
memory. Raw values are VARIANT: numbers, texts, booleans and whole objects keep their
types. Read back, a document is one VARIANT, taken apart by explode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.a1 import cell as address
from gridloom.functions.json_schema import errors
from gridloom.sources.document_schema import DOCUMENT, VERSION

#: The relations of documents. idx, ord and n are places from 0; raw, style, values, metadata and details hold any JSON.
HEADS = "doc string, title string, source_path string, template_id string, template_version string, metadata variant"
SHEETS = "doc string, idx int, sheet_id string, name string, metadata variant"
REGIONS = "doc string, idx int, ord int, region_id string, region_type string, title string, sheet string, range string, values variant, asset_ids array<string>, confidence double, metadata variant"
TABLES = "doc string, idx int, ord int, n int, table_id string, sheet string, range string, header_rows int, column_semantics map<string,string>, metadata variant"
CELLS = "doc string, idx int, ord int, n int, row int, col int, raw variant, display string, data_type string, formula string, style variant, merged_master string, row_span int, col_span int"
ASSETS = "doc string, idx int, n int, asset_id string, asset_type string, uri string, media_type string, description string, sheet string, range string, cell string, anchor string, extraction_status string, metadata variant"
DIAGNOSTICS = "doc string, idx int, n int, code string, severity string, message string, sheet string, range string, cell string, region_id string, details variant"


@dataclass(frozen=True)
class Parts:
    """The relations of a set of documents; idx is null for assets and diagnostics of the document itself."""

    heads: DataFrame
    sheets: DataFrame
    regions: DataFrame
    tables: DataFrame
    cells: DataFrame
    assets: DataFrame
    diagnostics: DataFrame


SCHEMAS = {"heads": HEADS, "sheets": SHEETS, "regions": REGIONS, "tables": TABLES, "cells": CELLS, "assets": ASSETS, "diagnostics": DIAGNOSTICS}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in SCHEMAS[name].split(", ")])


def raw_value(kind: Column, text: Column) -> Column:
    """VARIANT of a cell's text by its type: numbers, booleans; durations as seconds; dates and all else as texts (dates are ISO already)."""
    part = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("double")
    seconds = part(r"^(\d+):\d") * 3_600 + part(r":(\d+):") * 60 + part(r":(\d+(?:\.\d+)?)$")
    return (
        F.when(text.isNull(), None).when((kind == "number") & text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), F.try_parse_json(text)).when(kind == "boolean", F.try_parse_json(F.lower(text)))
        .when((kind == "duration") & text.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), F.try_parse_json(seconds.cast("string"))).otherwise(F.parse_json(quoted(text)))
    )


def quoted(text: Column) -> Column:
    """A text as JSON; null for null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def stringify(value: Column) -> Column:
    """A VARIANT as text: texts as they are, null as nothing, all else as JSON with sorted keys, characters kept."""
    return F.when(value.isNull() | F.is_variant_null(value), "").when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def cell_text(display: Column, raw: Column) -> Column:
    """What a cell shows, blanks kept: its display, else its raw value."""
    return F.coalesce(display, stringify(raw))


def _known(value: Column) -> Column:
    """A VARIANT as JSON; null where there is none, an empty object too."""
    text = F.to_json(value)
    return F.when(value.isNotNull() & ~F.is_variant_null(value) & (text != "{}"), text)


def _members(**columns: Column | None) -> Column:
    """`"name":json` of all that is not null, by name, with commas between."""
    return F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), c) for name, c in sorted(columns.items()) if c is not None])


def _source(sheet: str = "sheet", range: str | None = "range", cell: str | None = None) -> Column:
    inner = _members(sheet=quoted(F.col(sheet)), range=quoted(F.col(range)) if range else None, cell=quoted(F.col(cell)) if cell else None)
    return F.when(F.col(sheet).isNotNull(), F.concat(F.lit("{"), inner, F.lit("}")))


def _number(column: str, absent: int | None = None) -> Column:
    c = F.col(column)
    return F.when(c.isNotNull() if absent is None else c.isNotNull() & (c != absent), c.cast("string"))


def _texts(column: str) -> Column:
    return F.when(F.size(column) > 0, F.to_json(column))


def _sorted_map(column: str) -> Column:
    return F.when(F.size(column) > 0, F.to_json(F.parse_json(F.to_json(column))))


def _listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """(doc, idx, name): assets or diagnostics of a sheet or document as one JSON list; these are few for each."""
    items = F.array_sort(F.collect_list(F.struct("n", item.alias("j"))))
    return rows.groupBy("doc", "idx").agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]")).alias(name))


def canonical(parts: Parts) -> DataFrame:
    """(doc, ord, content): the pieces of each document's canonical JSON, in order; ord is a struct.

    Empty objects, empty lists and nulls are left out, and spans of 1. Each document
    has all pieces of its sheets, regions and tables, even empty ones.
    """
    asset = F.concat(F.lit("{"), _members(**{c: quoted(F.col(c)) for c in ("asset_id", "asset_type", "uri", "media_type", "description", "anchor", "extraction_status")}, source=_source(cell="cell"), metadata=_known(F.col("metadata"))), F.lit("}"))
    problem = F.concat(F.lit("{"), _members(**{c: quoted(F.col(c)) for c in ("code", "severity", "message", "region_id")}, source=_source(cell="cell"), details=_known(F.col("details"))), F.lit("}"))
    assets, problems = _listed(parts.assets, asset, "a"), _listed(parts.diagnostics, problem, "d")
    own = lambda df: df.where("idx IS NULL").drop("idx")
    heads = parts.heads.join(own(assets), "doc", "left").join(own(problems), "doc", "left")
    sheets = parts.sheets.join(assets, ["doc", "idx"], "left").join(problems, ["doc", "idx"], "left")

    def piece(df: DataFrame, kinds: tuple[int, ...], content: Column) -> DataFrame:
        """kinds: idx, ord, n, row and col of its place; -1 stands before, a large number after what is inside."""
        place = [F.lit(k) if isinstance(k, int) else F.col(k) for k in kinds]
        return df.select("doc", F.struct(*[p.cast("int").alias(f"p{i}") for i, p in enumerate(place)]).alias("ord"), content.alias("content"))

    after = 2**31 - 1
    comma = lambda key: F.when(F.col(key) > 0, ",").otherwise("")
    first = F.row_number().over(Window.partitionBy("doc", "idx", "ord", "n").orderBy("row", "col")) == 1
    style = _known(F.col("style"))
    inner = _members(
        coordinate=quoted(address(F.col("row"), F.col("col"))), row=_number("row"), column=_number("col"), raw_value=F.when(F.col("raw").isNotNull() & ~F.is_variant_null(F.col("raw")), F.to_json("raw")), display_value=quoted(F.col("display")),
        data_type=quoted(F.col("data_type")), formula=quoted(F.col("formula")), style=style, merged_master=quoted(F.col("merged_master")), row_span=_number("row_span", 1), col_span=_number("col_span", 1),
    )
    opened = lambda before, members, name: F.concat(before, F.lit("{"), members, F.when(members != "", ",").otherwise(""), F.lit(f'"{name}":['))
    closed = lambda members: F.concat(F.lit("]"), F.when(members != "", ",").otherwise(""), members, F.lit("}"))
    pieces = [
        piece(heads, (-1, -1, -1, -1, -1), opened(F.lit(""), _members(assets=F.col("a"), diagnostics=F.col("d"), document_id=quoted(F.col("doc")), metadata=_known(F.col("metadata")), schema_version=F.lit(f'"{VERSION}"')), "sheets")),
        piece(heads, (after, after, after, after, after), F.concat(closed(_members(**{c: quoted(F.col(c)) for c in ("source_path", "template_id", "template_version")}, title=quoted(F.coalesce("title", F.lit(""))))), F.lit("\n"))),
        piece(sheets, ("idx", -1, -1, -1, -1), opened(comma("idx"), _members(assets=F.col("a"), diagnostics=F.col("d"), index=_number("idx"), metadata=_known(F.col("metadata")), name=quoted(F.col("name"))), "regions")),
        piece(sheets, ("idx", after, after, after, after), closed(_members(sheet_id=quoted(F.col("sheet_id"))))),
        piece(parts.regions, ("idx", "ord", -1, -1, -1), opened(comma("ord"), _members(asset_ids=_texts("asset_ids"), confidence=F.when(F.col("confidence").isNotNull(), F.to_json(F.parse_json(F.col("confidence").cast("string")))), metadata=_known(F.col("metadata")), region_id=quoted(F.col("region_id")), region_type=quoted(F.col("region_type")), source=_source()), "tables")),
        piece(parts.regions, ("idx", "ord", after, after, after), closed(_members(title=quoted(F.col("title")), values=_known(F.col("values"))))),
        piece(parts.tables, ("idx", "ord", "n", -1, -1), opened(comma("n"), F.lit(""), "cells")),
        piece(parts.tables, ("idx", "ord", "n", after, after), closed(_members(column_semantics=_sorted_map("column_semantics"), header_rows=_number("header_rows", 0), metadata=_known(F.col("metadata")), source=_source(), table_id=quoted(F.col("table_id"))))),
        piece(parts.cells.withColumn("first", first), ("idx", "ord", "n", "row", "col"), F.concat(F.when(F.col("first"), "").otherwise(","), F.lit("{"), inner, F.lit("}"))),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def documents(canonical_rows: DataFrame) -> DataFrame:
    """(doc, value VARIANT) of canonical(); for documents that fit one value."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return canonical_rows.groupBy("doc").agg(F.parse_json(F.array_join(F.transform(ordered, lambda x: x["content"]), "")).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc, value) of the JSON documents below a path; value is null where a file is no JSON. A byte-order mark is skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    value = F.try_parse_json(F.regexp_replace("value", "^\\ufeff", ""))
    return files.select(F.input_file_name().alias("path"), value.alias("value")).select("path", F.coalesce(F.try_variant_get("value", "$.document_id", "string"), "path").alias("doc"), "value")


def _got(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _each(df: DataFrame, list_path: str, place: str, keep: list[str], of: str) -> DataFrame:
    """A row for each item of a list within VARIANT column `of`, with its place, as column `x`."""
    return df.select(*keep, F.posexplode(F.try_variant_get(of, f"$.{list_path}", "array<variant>")).alias(place, "x"))


def parts_of(values: DataFrame) -> Parts:
    """The relations of documents (doc, value); what breaks the schema is null in its column, see schema_diagnostics."""
    source = [_got("x", f"source.{c}", "string").alias(c) for c in ("sheet", "range")]
    texts = lambda *names: [_got("x", c, "string").alias(c) for c in names]
    part = lambda name: F.try_variant_get("x", f"$.{name}", "variant").alias(name)
    heads = values.select("doc", *[_got("value", c, "string").alias(c) for c in ("title", "source_path", "template_id", "template_version")], F.try_variant_get("value", "$.metadata", "variant").alias("metadata"))
    sheet = _each(values, "sheets", "idx", ["doc"], "value")
    region = _each(sheet, "regions", "ord", ["doc", "idx"], "x")
    table = _each(region, "tables", "n", ["doc", "idx", "ord"], "x")
    cell = _each(table, "cells", "k", ["doc", "idx", "ord", "n"], "x")
    cells = cell.select(
        "doc", "idx", "ord", "n", _got("x", "row", "int").alias("row"), _got("x", "column", "int").alias("col"), F.try_variant_get("x", "$.raw_value", "variant").alias("raw"), _got("x", "display_value", "string").alias("display"),
        *texts("data_type", "formula"), part("style"), *texts("merged_master"), F.coalesce(_got("x", "row_span", "int"), F.lit(1)).alias("row_span"), F.coalesce(_got("x", "col_span", "int"), F.lit(1)).alias("col_span"),
    )
    both = lambda name: _each(sheet, name, "n", ["doc", "idx"], "x").unionByName(_each(values.withColumn("idx", F.lit(None).cast("int")), name, "n", ["doc", "idx"], "value"))
    where = [*source, _got("x", "source.cell", "string").alias("cell")]
    return Parts(
        heads, sheet.select("doc", "idx", *texts("sheet_id", "name"), part("metadata")),
        region.select("doc", "idx", "ord", *texts("region_id", "region_type", "title"), *source, part("values"), F.coalesce(_got("x", "asset_ids", "array<string>"), F.array().cast("array<string>")).alias("asset_ids"), _got("x", "confidence", "double").alias("confidence"), part("metadata")),
        table.select("doc", "idx", "ord", "n", *texts("table_id"), *source, F.coalesce(_got("x", "header_rows", "int"), F.lit(0)).alias("header_rows"), F.coalesce(_got("x", "column_semantics", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("column_semantics"), part("metadata")),
        cells,
        both("assets").select("doc", "idx", "n", *texts("asset_id", "asset_type", "uri", "media_type", "description"), *where, *texts("anchor", "extraction_status"), part("metadata")),
        both("diagnostics").select("doc", "idx", "n", *texts("code", "severity", "message"), *where, *texts("region_id"), part("details")),
    )


def schema_diagnostics(values: DataFrame, schema: dict = DOCUMENT) -> DataFrame:
    """(doc, code, severity, location, keyword, message, sheet, region_id) of all that breaks the schema in documents (doc, value).

    location is the path with dots, $ for the root; sheet and region_id name what it
    lies in. A document that is no JSON (null) has one row of its own.
    """
    found = values.where(F.col("value").isNotNull()).select("doc", "value", F.explode(errors(schema, F.col("value"))).alias("e"))
    at = lambda i, name: F.when(F.get(F.col("e.path"), F.lit(i)) == name, F.get(F.col("e.path"), F.lit(i + 1)).cast("int"))
    sheets = F.try_variant_get("value", "$.sheets", "array<variant>")
    sheet = F.get(sheets, at(0, "sheets"))
    region = F.get(F.try_variant_get(sheet, "$.regions", "array<variant>"), at(2, "regions"))
    location = F.when(F.size("e.path") == 0, "$").otherwise(F.array_join("e.path", "."))
    rows = found.select(
        "doc", F.lit("schema.document_ir").alias("code"), F.lit("error").alias("severity"), location.alias("location"), F.col("e.keyword").alias("keyword"), F.concat(location, F.lit(": "), F.col("e.message")).alias("message"),
        F.try_variant_get(sheet, "$.name", "string").alias("sheet"), F.try_variant_get(region, "$.region_id", "string").alias("region_id"),
    )
    none = F.lit(None).cast("string")
    broken = values.where(F.col("value").isNull()).select("doc", F.lit("document.unreadable").alias("code"), F.lit("error").alias("severity"), F.lit("$").alias("location"), F.lit("json").alias("keyword"), F.lit("$: no JSON").alias("message"), none.alias("sheet"), none.alias("region_id"))
    return rows.unionByName(broken)


def template_of_documents(heads: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, template_id, version): the template a document names; without a version the latest of its id, by version parts as numbers.

    templates has template_id and version. Documents whose template is not there have null.
    """
    parts = F.transform(F.split("version", r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(-1)))
    latest = templates.groupBy("template_id").agg(F.max_by("version", F.struct(parts.alias("parts"), F.col("version"))).alias("latest"))
    exact = templates.select("template_id", F.col("version").alias("template_version"), F.col("version").alias("exact")).distinct()
    rows = heads.select("doc", "template_id", "template_version").join(F.broadcast(latest), "template_id", "left").join(F.broadcast(exact), ["template_id", "template_version"], "left")
    version = F.when(F.col("template_version").isNull(), F.col("latest")).otherwise(F.col("exact"))
    return rows.select("doc", F.when(version.isNotNull(), F.col("template_id")).alias("template_id"), version.alias("version"))

