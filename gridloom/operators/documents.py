"""Whole documents: chunks with metadata, canonical JSON, assets, cover sheets and readable views.

documents has doc, title, template, version; regions doc, sheet, region, kind, ord,
title; values doc, sheet, region, key, value, ord; assets doc, sheet (null: of the
document), asset, kind, uri, row. All work is by joins and groups over these keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import html_escape, markdown_cell, strip
from gridloom.operators.grid import SHEET, has_text
from gridloom.operators.render import split_parts

REGION = [*SHEET, "region"]
#: Names of cover sheets, endings of document types, titles that stand alone, labels of their attributes.
COVERS = ("表紙", "封面", "Cover")
DOCUMENT_TYPES = ("画面設計書", "詳細設計書", "基本設計書", "要件定義書")
PHASES = ("基本設計", "詳細設計", "画面設計", "要件定義")
ATTRIBUTES = ("文書番号", "バージョン", "作成者", "作成日", "更新者", "更新日", "承認者", "承認日", "レビュー者", "レビュー日")
#: Kinds of assets that are pictures.
VISUAL = ("image", "screenshot", "chart", "layout")


def filled(value: Column) -> Column:
    """Neither null, nor empty text, list or object."""
    return F.coalesce(~value.isin("", "[]", "{}"), F.lit(False))


def effective_assets(assets: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc, sheet, asset, kind, uri, row): the document's assets at every sheet, each replaced by the sheet's own of the same id."""
    shared = sheets.select(*SHEET).join(assets.where(F.col("sheet").isNull()).drop("sheet"), "doc").withColumn("rank", F.lit(1))
    own = assets.where(F.col("sheet").isNotNull()).withColumn("rank", F.lit(0))
    columns = [*SHEET, "asset", "kind", "uri", "row"]
    first = F.row_number().over(Window.partitionBy(*SHEET, "asset").orderBy("rank"))
    return own.select(*columns, "rank").unionByName(shared.select(*columns, "rank")).withColumn("n", first).where("n = 1").select(*columns)


def numbered_assets(assets: DataFrame) -> DataFrame:
    """assets with `number`: their place among those of their kind on the sheet, by row; those without one last."""
    return assets.withColumn("number", F.row_number().over(Window.partitionBy(*SHEET, "kind").orderBy(F.col("row").asc_nulls_last(), "asset")))


def bind_assets(bindings: DataFrame, assets: DataFrame, sheets: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New asset rows for bindings (doc, asset, sheet, region, uri) that no asset has, and (doc, asset, code) of those that name what isn't there."""
    new = bindings.join(assets.select("doc", "asset").distinct(), ["doc", "asset"], "left_anti")
    known = bindings.join(sheets.select(*SHEET, F.lit(True).alias("has_sheet")).distinct(), SHEET, "left").join(regions.select(*REGION, F.lit(True).alias("has_region")).distinct(), REGION, "left")
    code = F.when(F.col("sheet").isNotNull() & F.col("has_sheet").isNull(), "asset.sheet_missing").when(F.col("region").isNotNull() & F.col("has_region").isNull(), "asset.region_missing")
    return new, known.withColumn("code", code).where(F.col("code").isNotNull()).select("doc", "asset", "code")


def collapse_masters(members: DataFrame) -> DataFrame:
    """(doc, sheet, row, col, …) without columns that show the same merged cell as the column before: mr, mc is its master."""
    before = Window.partitionBy(*SHEET, "row").orderBy("col")
    same = F.col("mr").isNotNull() & (F.lag("mr").over(before) == F.col("mr")) & (F.lag("mc").over(before) == F.col("mc"))
    return members.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).drop("same")


def semantic_columns(columns: DataFrame, semantics: DataFrame) -> DataFrame:
    """(doc, sheet, col): the present columns that have a meaning, in order; all of them on sheets where none has."""
    marked = columns.select(*SHEET, "col").distinct().join(semantics.select(*SHEET, "col", F.lit(True).alias("means")).distinct(), [*SHEET, "col"], "left")
    some = F.bool_or(F.coalesce("means", F.lit(False))).over(Window.partitionBy(*SHEET))
    return marked.withColumn("some", some).where(~F.col("some") | F.coalesce("means", F.lit(False))).select(*SHEET, "col")


def readable_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(…, label, value, ord): filled values by the label of their key (doc, sheet, region, key, label), or the key itself."""
    first = labels.groupBy(*REGION, "key").agg(F.min("label").alias("label"))
    rows = values.where(filled(F.col("value"))).join(first, [*REGION, "key"], "left")
    return rows.select(*REGION, "ord", F.coalesce(F.nullif("label", F.lit("")), "key").alias("label"), "value")


def renderable(regions: DataFrame, values: DataFrame, cells: DataFrame, assets: DataFrame) -> DataFrame:
    """regions that are recognised and have a filled value, a table cell with text (doc, sheet, region, display) or an asset."""
    some = values.where(filled(F.col("value"))).select(*REGION).unionByName(cells.where(has_text(F.col("display"))).select(*REGION)).unionByName(assets.where(F.col("region").isNotNull()).select(*REGION)).distinct()
    return regions.where(~F.col("region").startswith("unrecognized")).join(some, REGION, "left_semi")


def interleaved(kind: Column, mode: Column, extractor: Column) -> Column:
    """Whether text and pictures of a region alternate by row: a layout, or extracted as an asset, and not shown as a screenshot."""
    return ~mode.eqNullSafe(F.lit("screenshot")) & (kind.eqNullSafe(F.lit("layout")) | extractor.eqNullSafe(F.lit("asset")))


def screen_ids(metadata: DataFrame, candidates: list[str]) -> DataFrame:
    """(doc, screen_id): the first filled value among the candidate keys, the document's own (rank 0) before its regions'."""
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("key"))
    rows = metadata.where(F.col("key").isin(candidates) & filled(F.col("value")))
    return rows.groupBy("doc").agg(F.min_by("value", F.struct("rank", place, "ord")).alias("screen_id"))


def chunks(documents: DataFrame, regions: DataFrame, values: DataFrame, ids: DataFrame, limit: int = 4_000) -> DataFrame:
    """(chunk_id, kind, text, metadata): a chunk for each document and each region, split where it is over the limit.

    metadata is JSON without nulls. The rows of tables come from render.knowledge_rows().
    """
    base = documents.join(ids, "doc", "left").withColumn("base", F.struct(F.col("doc").alias("document_id"), F.col("title").alias("document_title"), F.col("template").alias("template_id"), F.col("version").alias("template_version"), "screen_id"))
    lines = lambda keys: values.where(filled(F.col("value"))).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "region", "ord", "key", "value"))), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n").alias("lines"))
    whole = base.select(F.concat("doc", F.lit(":document")).alias("id"), F.lit("document").alias("kind"), F.col("title").alias("text"), F.to_json("base").alias("metadata"))
    own = regions.join(lines(REGION), REGION, "left").join(base.select("doc", "base"), "doc")
    fields = F.struct("base.*", F.col("sheet").alias("sheet_id"), F.col("region").alias("region_id"), F.col("region_kind").alias("region_type"))
    own = own.withColumnRenamed("title", "head").withColumnRenamed("kind", "region_kind")
    section = own.select(F.concat_ws(":", "doc", "sheet", "region").alias("id"), F.lit("section").alias("kind"), F.concat_ws("\n", F.coalesce("head", "region"), "lines").alias("text"), F.to_json(fields).alias("metadata"))
    rows = whole.unionByName(section)
    parts = rows.select("id", "kind", (F.length("text") > limit).alias("long"), F.posexplode(split_parts(F.col("text"), limit)).alias("at", "text"), "metadata")
    return parts.select(F.when(F.col("long"), F.concat("id", F.lit(":part-"), (F.col("at") + 1).cast("string"))).otherwise(F.col("id")).alias("chunk_id"), "kind", "text", "metadata")


def canonical(cells: DataFrame) -> DataFrame:
    """(doc, json): one line of JSON for each document, its keys and cells in order, absent values left out."""
    cell = F.struct("col", F.col("display").alias("text"))
    rows = cells.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    sheets = rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    inner = F.transform("rows", lambda r: F.struct(r["cells"].alias("cells"), r["row"].alias("row")))
    docs = sheets.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("sheet").alias("name"), inner.alias("rows")))).alias("sheets"))
    return docs.select("doc", F.to_json(F.struct(F.col("doc").alias("document_id"), "sheets")).alias("json"))


CANONICAL = "document_id string, sheets array<struct<name: string, rows: array<struct<cells: array<struct<col: bigint, text: string>>, row: bigint>>>>"


def from_canonical(rows: DataFrame, json: str = "json") -> DataFrame:
    """(doc, sheet, row, col, display) of canonical JSON; a byte-order mark at the start is skipped, broken lines fail."""
    parsed = rows.select(F.from_json(F.regexp_replace(json, "^﻿", ""), CANONICAL, {"mode": "FAILFAST"}).alias("d"))
    sheets = parsed.select(F.col("d.document_id").alias("doc"), F.explode("d.sheets").alias("s"))
    lines = sheets.select("doc", F.col("s.name").alias("sheet"), F.explode("s.rows").alias("r"))
    return lines.select(*SHEET, F.col("r.row").alias("row"), F.explode("r.cells").alias("c")).select(*SHEET, "row", "c.col", F.col("c.text").alias("display"))


def document_type(names: Column, wanted: Column) -> Column:
    """The wanted type, or what the names of the sheets tell."""
    joined = F.array_join(names, " ")
    return F.when(filled(wanted), wanted).when(joined.contains("帳票"), "report-design").when(joined.contains("画面") | joined.contains("表紙"), "screen-design").otherwise("generic")


def _label(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[：:]+$", ""))


def _is_type(text: Column) -> Column:
    return strip(text).rlike("(?:" + "|".join(DOCUMENT_TYPES) + ")$")


def cover_sheets(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, sheet, cover): named like one, or with a document type and a two-cell attribute row and without a main table (doc, sheet, start)."""
    full = cells.where(has_text(F.col("display")))
    rows = full.groupBy(*SHEET, "row").agg(F.bool_or(_is_type(F.col("display"))).alias("typed"), F.count("*").alias("n"), F.min_by("display", "col").alias("first"))
    attribute = (F.col("n") == 2) & _label(F.col("first")).isin(*ATTRIBUTES)
    sheets = rows.groupBy(*SHEET).agg(F.bool_or("typed").alias("typed"), F.bool_or(attribute).alias("attributes"))
    joined = sheets.join(tables.select(*SHEET, "start"), SHEET, "left")
    return joined.select(*SHEET, (strip(F.col("sheet")).isin(*COVERS) | F.col("typed") & F.col("attributes") & F.col("start").isNull()).alias("cover"))


def cover_line(text: Column) -> Column:
    """What a line of a cover sheet is; the first that holds."""
    t = strip(text)
    return F.when(t.isin(*PHASES), "phase").when(t.rlike(r"(?i)^SCR-A\d+$"), "screen_id").when(_is_type(t), "doc_type").when(F.length(t) > 30, "project").when(t.rlike("[_＿]") | t.contains("平時"), "subsystem").otherwise("screen_name")


def cover_fields(cells: DataFrame) -> DataFrame:
    """(doc, sheet, field, value, ord): lines of one cell by cover_line(), the last of each kind but the first screen name; attribute rows, the first of each."""
    full = cells.where(has_text(F.col("display")))
    rows = full.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.min_by("display", "col").alias("a"), F.max_by("display", "col").alias("b"))
    lines = rows.where("n = 1").select(*SHEET, "row", cover_line(F.col("a")).alias("field"), strip(F.col("a")).alias("value"))
    lines = lines.groupBy(*SHEET, "field").agg(F.when(F.first("field") == "screen_name", F.min_by("value", "row")).otherwise(F.max_by("value", "row")).alias("value"), F.min("row").alias("ord"))
    pairs = rows.where((F.col("n") == 2) & _label(F.col("a")).isin(*ATTRIBUTES)).select(*SHEET, _label(F.col("a")).alias("field"), F.col("b").alias("value"), "row")
    pairs = pairs.groupBy(*SHEET, "field").agg(F.min_by("value", "row").alias("value"), F.min("row").alias("ord"))
    return lines.unionByName(pairs)


def preview(cells: DataFrame, rows: int = 41, columns: int = 21) -> DataFrame:
    """The cells of the first rows and columns of each sheet, counted from its first cell."""
    corner = cells.groupBy(*SHEET).agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    return cells.join(corner, SHEET).where((F.col("row") < F.col("r0") + rows) & (F.col("col") < F.col("c0") + columns)).drop("r0", "c0")


def document_texts(titles: DataFrame, sheets: DataFrame, style: str = "md") -> DataFrame:
    """(doc, content): a title, a list of links to the sheets, and a section for each sheet's content, as Markdown or HTML."""
    if style == "md":
        section = F.concat(F.lit("\n## "), markdown_cell(F.col("sheet")), F.lit("\n\n"), "content")
        link = F.concat(F.lit("- ["), markdown_cell(F.col("sheet")), F.lit("](#"), F.lower(F.replace("sheet", F.lit(" "), F.lit("-"))), F.lit(")"))
        whole = F.concat(F.lit("# "), markdown_cell(F.col("title")), F.lit("\n\n"), F.array_join("links", "\n"), F.lit("\n"), F.array_join("sections", ""))
    else:
        name = html_escape(F.col("sheet"))
        section = F.concat(F.lit('<section id="'), name, F.lit('"><h2>'), name, F.lit("</h2><table>\n"), "content", F.lit("</table></section>\n"))
        link = F.concat(F.lit('<li><a href="#'), name, F.lit('">'), name, F.lit("</a></li>"))
        head = html_escape(F.col("title"))
        whole = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), head, F.lit("</title></head><body><h1>"), head, F.lit("</h1><nav><ul>"), F.array_join("links", ""), F.lit("</ul></nav>\n"), F.array_join("sections", ""), F.lit("</body></html>\n"))
    parts = sheets.select("doc", F.struct("sheet", link.alias("link"), section.alias("section")).alias("p"))
    docs = parts.groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("p")).select("doc", F.transform("p", lambda x: x["link"]).alias("links"), F.transform("p", lambda x: x["section"]).alias("sections"))
    return docs.join(titles.select("doc", "title"), "doc").select("doc", whole.alias("content"))
