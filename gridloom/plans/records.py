"""Queries over documents, their schemas and rules, files and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import paths
from gridloom.operators import business, captions, outputs
from gridloom.operators.document_rules import RegionRules, Rule, RuleSet, SheetRules, diagnostics
from gridloom.plans import views
from gridloom.plans.registry import BLANK, CLOCK, SRT, query
from gridloom.sources import documents

#: The columns of the customers' tables, by letter.
MEANING = {"A": "name", "B": "nation", "C": "balance"}


def customer_documents(spark: SparkSession, sf_dir: str) -> documents.Parts:
    """The customers' sheets as documents: a region r with one table of a header row in each sheet."""
    none = lambda kind: F.lit(None).cast(kind)
    cells = views.cells(spark, sf_dir)
    place = F.dense_rank().over(Window.partitionBy("doc").orderBy("sheet")) - 1
    sheets = cells.select("doc", "sheet").distinct().withColumn("idx", place)
    kind = F.when(F.col("display").rlike(r"^-?\d+$"), "number").otherwise("string")
    full = cells.join(F.broadcast(sheets), ["doc", "sheet"]).select(
        "doc", "idx", F.lit(0).alias("ord"), F.lit(0).alias("n"), "row", "col", documents.raw_value(kind, F.col("display")).alias("raw"), "display", kind.alias("data_type"), none("string").alias("formula"),
        F.when(F.col("bold"), F.parse_json(F.lit('{"font":{"bold":true}}'))).alias("style"), none("string").alias("merged_master"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"),
    )
    own = sheets.withColumns({"ord": F.lit(0), "n": F.lit(0)})
    region = own.select("doc", "idx", "ord", F.lit("r").alias("region_id"), F.lit("table").alias("region_type"), none("string").alias("title"), "sheet", none("string").alias("range"), none("variant").alias("values"), F.array().cast("array<string>").alias("asset_ids"), F.lit(1.0).alias("confidence"), none("variant").alias("metadata"))
    meaning = F.create_map(*[F.lit(x) for pair in MEANING.items() for x in pair])
    tables = own.select("doc", "idx", "ord", "n", F.lit("t").alias("table_id"), "sheet", none("string").alias("range"), F.lit(1).alias("header_rows"), meaning.alias("column_semantics"), none("variant").alias("metadata"))
    heads = sheets.select("doc").distinct().select("doc", F.col("doc").alias("title"), none("string").alias("source_path"), none("string").alias("template_id"), none("string").alias("template_version"), none("variant").alias("metadata"))
    named = sheets.select("doc", "idx", F.concat(F.lit("s"), "idx").alias("sheet_id"), F.col("sheet").alias("name"), none("variant").alias("metadata"))
    return documents.Parts(heads, named, region, tables, full, documents.empty(spark, "assets"), documents.empty(spark, "diagnostics"))


PLACED = "ranked AS (SELECT doc, sheet, dense_rank() OVER (PARTITION BY doc ORDER BY sheet) - 1 AS idx FROM (SELECT DISTINCT doc, sheet FROM v_cells))"


@query("canonical_roundtrip", f""", {PLACED} SELECT doc, idx, "row", CAST(col AS BIGINT) AS col, CASE WHEN regexp_matches(display, '^-?[0-9]+$') THEN display ELSE '"' || display || '"' END AS raw, display,
 CASE WHEN regexp_matches(display, '^-?[0-9]+$') THEN 'number' ELSE 'string' END AS data_type, bold FROM v_cells JOIN ranked USING (doc, sheet)""")
def _(view, table):
    """Cells of all documents after canonical JSON and back."""
    spark, sf_dir = view("session_and_folder")
    values = documents.documents(documents.canonical(customer_documents(spark, sf_dir)))
    cells = documents.parts_of(values).cells
    return cells.select("doc", "idx", "row", "col", F.to_json("raw").alias("raw"), "display", "data_type", F.coalesce(F.try_variant_get("style", "$.font.bold", "boolean"), F.lit(False)).alias("bold"))


def whole(pieces: DataFrame) -> DataFrame:
    """(doc, content) of a document's pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return pieces.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("content"))


#: The rows of the customers' tables that have any text in the columns with a meaning, by sheet.
ROWS = """r AS (SELECT doc, sheet, "row" AS n, max(display) FILTER (col = 1) AS a, max(display) FILTER (col = 2) AS b, max(display) FILTER (col = 3) AS c FROM v_cells WHERE "row" > 1 AND col <= 3 GROUP BY ALL HAVING max(display) <> '')"""


@query("md_business", f""", {PLACED}, {ROWS}, body AS (SELECT doc, sheet, string_agg('| ' || a || ' | ' || b || ' | ' || c || ' |' || chr(10), '' ORDER BY n) AS lines FROM r GROUP BY doc, sheet),
 parts AS (SELECT doc, idx, '## ' || sheet || chr(10) || chr(10) || coalesce('### r' || chr(10) || chr(10) || '|  |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines || chr(10), '') AS part FROM ranked LEFT JOIN body USING (doc, sheet))
 SELECT doc, '# ' || doc || chr(10) || chr(10) || string_agg(part, '' ORDER BY idx) AS content FROM parts GROUP BY doc""")
def _(view, table):
    """The customers' documents as Markdown."""
    return whole(business.markdown(customer_documents(*view("session_and_folder"))))


@query("html_business", f""", {PLACED}, {ROWS}, body AS (SELECT doc, sheet, string_agg('<tr><td>' || a || '</td><td>' || b || '</td><td>' || c || '</td></tr>', '' ORDER BY n) AS lines FROM r GROUP BY doc, sheet),
 parts AS (SELECT doc, idx, sheet, lines, 'sheet-' || idx || '-s' || idx AS anchor FROM ranked LEFT JOIN body USING (doc, sheet)),
 shown AS (SELECT doc, idx, '<li><a href="#' || anchor || '">' || sheet || '</a><ol>' || CASE WHEN lines IS NULL THEN '' ELSE '<li><a href="#' || anchor || '-region-0-r">r</a></li>' END || '</ol></li>' AS nav,
  '<section id="' || anchor || '"><h2>' || sheet || '</h2>' || CASE WHEN lines IS NULL THEN '' ELSE '<section id="' || anchor || '-region-0-r" data-region-type="table"><h3>r</h3><div class="table-wrap"><table><tr><th></th><th></th><th></th></tr>' || lines || '</table></div></section>' END || '</section>' AS part FROM parts)
 SELECT doc, '<!doctype html>' || chr(10) || '<html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>' || doc || '</title><style>{business.STYLE}</style></head><body><nav><ol>' || string_agg(nav, '' ORDER BY idx)
 || '</ol></nav><main><h1>' || doc || '</h1>' || string_agg(part, '' ORDER BY idx) || '</main></body></html>' || chr(10) AS content FROM shown GROUP BY doc""")
def _(view, table):
    """The customers' documents as HTML."""
    return whole(business.html(customer_documents(*view("session_and_folder"))))


#: What a message should be; real ones break it.
MESSAGE = {
    "type": "object", "required": ["role", "text"], "additionalProperties": False,
    "properties": {"role": {"enum": ["user", "assistant"]}, "text": {"type": "string", "maxLength": 120, "pattern": "^[A-Z]"}, "turn": {"type": "integer", "maximum": 3}},
}


@query("schema_diagnostics", """, m AS (SELECT conv_id || '-' || turn AS doc, "role" AS r, turn, "text" AS t FROM conversations),
 e AS (SELECT doc, 'role' AS location, 'enum' AS keyword, '''' || r || ''' is not one of [''user'', ''assistant'']' AS words FROM m WHERE r NOT IN ('user', 'assistant')
 UNION ALL SELECT doc, 'text', 'pattern', '''' || t || ''' does not match ''^[A-Z]''' FROM m WHERE NOT regexp_matches(t, '^[A-Z]')
 UNION ALL SELECT doc, 'text', 'maxLength', '''' || t || ''' is too long' FROM m WHERE length(t) > 120
 UNION ALL SELECT doc, 'turn', 'maximum', turn || ' is greater than the maximum of 3' FROM m WHERE turn > 3)
 SELECT doc, 'schema.document_ir' AS code, 'error' AS severity, location, keyword, location || ': ' || words AS message FROM e""")
def _(view, table):
    """What breaks the schema of messages, over all messages as VARIANT."""
    rows = table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), F.parse_json(F.to_json(F.struct("role", "text", "turn"))).alias("value"))
    return documents.schema_diagnostics(rows, MESSAGE).drop("sheet", "region_id")


RULES = RuleSet(
    (SheetRules("cars", "^auto", True, (RegionRules("r", True, (
        Rule("name", "required", "name", "warning"), Rule("nation", "unique", "nation", "info"), Rule("balance", "regex", "balance", options={"pattern": "^-?[0-9]{4}$"}), Rule("elsewhere", "reference", "nation", options={"target": "machinery.r.nation"}),
    )),)), SheetRules("planes", "^plane", True), SheetRules("boats", "^boat", False)),
    (Rule("made", "unique", "Machinery.r.nation", message="a nation twice"), Rule("afloat", "required", "boats.r.name"), Rule("lost", "required", "s0.none.name")),
)


@query("rule_paths", f""", {PLACED}, d AS (SELECT doc, sheet, col, display FROM v_cells WHERE "row" > 1),
 docs AS (SELECT DISTINCT doc FROM v_cells), cars AS (SELECT * FROM d WHERE sheet = 'AUTOMOBILE'), made AS (SELECT * FROM d WHERE sheet = 'MACHINERY' AND col = 2 AND display <> ''),
 out AS (SELECT doc, 'name' AS rule_id, 'required' AS kind, 'warning' AS severity, 'no value for name' AS message, sheet, 'r' AS region_id, 'name' AS field, NULL AS value, count(*) AS n FROM cars WHERE col = 1 AND display = '' GROUP BY doc, sheet
 UNION ALL SELECT doc, 'nation', 'unique', 'info', 'nation is not unique', sheet, 'r', 'nation', display, count(*) FROM cars WHERE col = 2 AND display <> '' GROUP BY doc, sheet, display HAVING count(*) > 1
 UNION ALL SELECT doc, 'balance', 'regex', 'error', 'balance does not match', sheet, 'r', 'balance', display, count(*) FROM cars WHERE col = 3 AND display <> '' AND NOT regexp_matches(display, '^-?[0-9]{{4}}$') GROUP BY doc, sheet, display
 UNION ALL SELECT doc, 'elsewhere', 'reference', 'error', 'nation is not in machinery.r.nation', sheet, 'r', 'nation', display, count(*) FROM cars c WHERE col = 2 AND display <> '' AND NOT EXISTS (SELECT 1 FROM made m WHERE m.doc = c.doc AND m.display = c.display)
  AND EXISTS (SELECT 1 FROM v_cells v WHERE v.doc = c.doc AND v.sheet = 'MACHINERY') GROUP BY doc, sheet, display
 UNION ALL SELECT doc, 'elsewhere', 'reference', 'error', 'no target machinery.r.nation', sheet, 'r', 'nation', 'machinery.r.nation', 1 FROM (SELECT DISTINCT doc, sheet FROM v_cells WHERE sheet = 'AUTOMOBILE') c WHERE NOT EXISTS (SELECT 1 FROM v_cells v WHERE v.doc = c.doc AND v.sheet = 'MACHINERY')
 UNION ALL SELECT doc, 'made', 'unique', 'error', 'a nation twice', sheet, 'r', 'Machinery.r.nation', display, count(*) FROM made GROUP BY doc, sheet, display HAVING count(*) > 1
 UNION ALL SELECT doc, 'lost', 'required', 'error', 'no field or column s0.none.name', (SELECT sheet FROM ranked WHERE ranked.doc = docs.doc AND idx = 0), 'none', 's0.none.name', NULL, 1 FROM docs
 UNION ALL SELECT doc, 'required_sheet', 'required_sheet', 'error', 'no sheet for planes', NULL, NULL, '', NULL, 1 FROM docs
 UNION ALL SELECT doc, 'required_sheet', 'required_sheet', 'error', 'no sheet for cars', NULL, NULL, '', NULL, 1 FROM docs WHERE NOT EXISTS (SELECT 1 FROM v_cells v WHERE v.doc = docs.doc AND v.sheet = 'AUTOMOBILE'))
 SELECT doc, rule_id, 'business.' || kind AS code, severity, message, sheet, region_id, field, CAST(value AS VARCHAR) AS value, CAST(n AS BIGINT) AS n FROM out""")
def _(view, table):
    """Rules of regions and of documents over the customers' documents."""
    return diagnostics(customer_documents(*view("session_and_folder")), RULES)


LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS link FROM pages)"
BARE = "list_filter(string_split(replace(link, chr(92), '/'), '/'), lambda x: x <> '')"


@query("link_paths", f"""WITH {LINKS}, p AS (SELECT page_id, link, CASE WHEN trim(link) = '' THEN 'empty' WHEN regexp_matches(link, '^[/\\\\]') THEN 'absolute' WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'scheme' END AS kind,
 list_reduce([''] || list_filter({BARE}, lambda x: x <> '.'), lambda a, x: CASE WHEN starts_with(a, '!') THEN a WHEN x = '..' AND a = '' THEN '!' WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) AS walked FROM links)
 SELECT page_id, link, coalesce(kind, CASE WHEN walked = '' OR starts_with(walked, '!') THEN 'outside' END) AS problem, CASE WHEN kind IS NULL AND walked <> '' AND NOT starts_with(walked, '!') THEN ltrim(walked, '/') END AS path,
 array_to_string(list_transform({BARE}, lambda x: url_encode(x)), '/') AS uri, count(*) AS n FROM p GROUP BY ALL""")
def _(view, table):
    """All links of all pages as paths and URIs."""
    links = table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("link"))
    rows = links.select("page_id", "link", paths.path_problem(F.col("link")).alias("problem"), paths.normal_path(F.col("link")).alias("path"), paths.uri_path(F.col("link")).alias("uri"))
    return rows.groupBy("page_id", "link", "problem", "path", "uri").agg(F.count("*").alias("n"))


@query("corrected_transcript", f""", r AS (SELECT session, start_ms, end_ms, text, row_number() OVER (PARTITION BY session ORDER BY start_ms, end_ms, text) AS n FROM v_segments WHERE status <> 'Partial' AND trim(text, {BLANK}) <> '')
 SELECT session || '/corrected-transcript.txt' AS file, n AS ord, '[' || {CLOCK.format("start_ms")} || '] ' || text || chr(10) AS content FROM r
 UNION ALL SELECT session || '/corrected-transcript.srt', n, n || chr(13) || chr(10) || {SRT.format("start_ms")} || ' --> ' || {SRT.format("end_ms")} || chr(13) || chr(10) || text || chr(13) || chr(10) || chr(13) || chr(10) FROM r""")
def _(view, table):
    """The pieces of the text and subtitle files of a second pass."""
    rows = captions.persisted(view("segments")).select("session", "start_ms", "end_ms", "text", F.lit(None).cast("double").alias("confidence"))
    return outputs.corrected_files(rows).where(~F.col("file").endswith(".json"))


@query("sheet_files", """, s AS (SELECT DISTINCT doc, sheet, doc || '_' || sheet AS base FROM v_cells)
 SELECT doc, sheet, base || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END || '.csv' AS file FROM s WINDOW w AS (PARTITION BY lower(base) ORDER BY doc, sheet)""")
def _(view, table) -> DataFrame:
    """The file of each sheet."""
    return outputs.sheet_files(view("cells"), "csv")
