"""Documents as readable Markdown and HTML, in one plan over their relations.

Each table takes the form that fits it: a list without header rows, the columns that
have a meaning, HTML where cells are merged, else the grid. Layout regions put texts
and pictures in the order of their rows; pictures without a place follow the clusters
of rows. Every line is a row with its place, so no document is held by a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.a1 import cell as address
from gridloom.functions.a1 import letters
from gridloom.functions.paths import asset_uri
from gridloom.functions.text import html_escape, strip
from gridloom.operators.render import BANNER
from gridloom.sources.documents import Parts, cell_text, stringify

REGION, TABLE = ["doc", "idx", "ord"], ["doc", "idx", "ord", "n"]
#: Places inside a region: what stands before, its pairs, its tables or blocks, its assets, what stands after.
HEAD, PAIRS, BODY, ASSETS, TAIL = range(5)
LAST = 2**31 - 1
GAP = 2
PICTURES = ("image", "screenshot", "chart", "layout")
#: How documents begin and end (fixed values of the format, but for the style).
STYLE = "body{margin:auto;max-width:90rem;font:16px/1.6 sans-serif}nav{padding:1rem}.table-wrap{overflow:auto}table{border-collapse:collapse}th,td{border:1px solid;padding:.4rem;vertical-align:top}img{max-width:100%;height:auto}@media (max-width:50rem){nav{padding:0}}"


def escape(text: Column) -> Column:
    """For a Markdown table or list: backslashes and pipes escaped, line ends as <br>."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def _logical(parts: Parts) -> DataFrame:
    """(TABLE, row, col, text, own): the text at each position and the address of the cell it is of; merged positions have their master's."""
    cells = parts.cells.select(*TABLE, "row", "col", cell_text(F.col("display"), F.col("raw")).alias("text"), address(F.col("row"), F.col("col")).alias("own"), "merged_master", "row_span", "col_span")
    masters = cells.select(*TABLE, F.col("own").alias("merged_master"), F.col("text").alias("m_text"))
    at = cells.join(masters, [*TABLE, "merged_master"], "left")
    placed = at.select(*TABLE, "row", "col", F.coalesce("m_text", "text").alias("text"), F.when(F.col("m_text").isNotNull(), F.col("merged_master")).otherwise(F.col("own")).alias("own"), F.lit(0).alias("by"))
    columns = cells.groupBy(*TABLE).agg(F.collect_set("col").alias("cols"))
    wide = cells.where(F.col("merged_master").isNull() & ((F.col("row_span") > 1) | (F.col("col_span") > 1))).join(columns, TABLE)
    inside = F.filter("cols", lambda c: c.between(F.col("col"), F.col("col") + F.col("col_span") - 1))
    spread = wide.select(*TABLE, "text", "own", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), inside.alias("c")).select(*TABLE, "row", F.explode("c").alias("col"), "text", "own", F.lit(1).alias("by"))
    # A cell of its own goes before one that covers the place.
    return placed.unionByName(spread).groupBy(*TABLE, "row", "col").agg(F.min_by(F.struct("text", "own"), F.struct("by", "own")).alias("x")).select(*TABLE, "row", "col", "x.text", "x.own")


def forms(parts: Parts) -> DataFrame:
    """(TABLE, form, cols, labels, top, header_rows, table_id): how each table with cells is shown, and by which columns."""
    facts = parts.cells.groupBy(*TABLE).agg(
        F.array_sort(F.collect_set("col")).alias("present"), F.min("row").alias("top"),
        F.bool_or(F.col("merged_master").isNotNull() | (F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"),
    )
    rows = parts.tables.join(facts, TABLE)
    meant = F.filter("present", lambda c: F.map_contains_key("column_semantics", letters(c)))
    cols = F.when(F.size(meant) > 0, meant).otherwise(F.col("present"))
    form = F.when(F.col("header_rows") <= 0, "list").when(F.size("column_semantics") > 0, "compact").when(F.col("merged"), "html").otherwise("grid")
    labels = F.try_variant_get("metadata", "$.header_labels", "map<string,string>")
    named = F.transform(cols, lambda c: F.coalesce(F.try_element_at(labels, letters(c)), F.lit("")))
    return rows.select(*TABLE, form.alias("form"), cols.alias("cols"), named.alias("labels"), "top", "header_rows", "table_id")


def _aligned(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """tables with a row for each row of cells: texts and own, by the table's columns."""
    rows = cells.groupBy(*TABLE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("text", "own")))).alias("m")).join(tables, TABLE)
    at = lambda name, none: F.transform("cols", lambda c: F.coalesce(F.try_element_at(F.col("m"), c)[name], none))
    return rows.withColumns({"texts": at("text", F.lit("")), "own": at("own", F.lit(None).cast("string"))}).drop("m")


def content_rows(parts: Parts) -> DataFrame:
    """The rows of tables below their headers that have any text, with forms()."""
    rows = _aligned(_logical(parts), forms(parts))
    return rows.where((F.col("row") >= F.col("top") + F.greatest("header_rows", F.lit(0))) & F.exists("texts", lambda t: t != ""))


def _listed(texts: str = "texts", own: str = "own") -> Column:
    """The texts of a row with one for each run of columns that show the same cell."""
    pairs = F.zip_with(texts, own, lambda t, o: F.struct(t.alias("t"), o.alias("o")))
    fresh = F.filter(pairs, lambda p, i: (i == 0) | p["o"].isNull() | ~p["o"].eqNullSafe(F.get(F.col(own), i - 1)))
    return F.array_join(F.filter(F.transform(fresh, lambda p: p["t"]), lambda t: t != ""), " / ")


def _banner() -> Column:
    """The text of a row that only names a group; null for other rows."""
    texts = F.array_distinct(F.filter(F.transform("texts", strip), lambda t: t != ""))
    return F.when((F.size(texts) == 1) & F.get(texts, F.lit(0)).rlike(f"(?i){BANNER}"), F.get(texts, F.lit(0)))


def shown_regions(parts: Parts, content: DataFrame) -> DataFrame:
    """The regions that are shown: recognised ones with a value, an asset or a table with text; with heading, mode and pairs."""
    pairs = F.filter(F.map_entries(F.coalesce(F.try_variant_get("values", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda e: ~F.is_variant_null(e["value"]) & ~F.to_json(e["value"]).isin('""', "[]", "{}"))
    given, reverse = (F.try_variant_get("metadata", f"$.{name}", "map<string,string>") for name in ("value_labels", "key_labels"))
    told = lambda key: F.coalesce(F.try_element_at(given, key), F.get(F.filter(F.map_entries(reverse), lambda e: e["value"] == key), F.lit(0))["key"], key)
    texts = F.transform(pairs, lambda e: F.struct(told(e["key"]).alias("key"), stringify(e["value"]).alias("text")))
    mode = F.when(F.try_variant_get("metadata", "$.readable_mode", "string") == "screenshot", "screenshot").when((F.col("region_type") == "layout") | (F.try_variant_get("metadata", "$.extractor_kind", "string") == "asset"), "layout").otherwise("tables")
    full = content.select(*REGION).distinct().withColumn("full", F.lit(True))
    rows = parts.regions.withColumns({"pairs": texts, "mode": mode}).join(full, REGION, "left")
    return rows.where(~F.col("region_id").startswith("unrecognized") & ((F.size("pairs") > 0) | (F.size("asset_ids") > 0) | F.coalesce("full", F.lit(False)))).select(
        *REGION, F.coalesce("title", "region_id").alias("heading"), "region_id", "region_type", "mode", "pairs", "asset_ids",
    )


def asset_places(parts: Parts, regions: DataFrame, content: DataFrame, folder: str) -> DataFrame:
    """(REGION, part, row, k, seq, picture, label, uri): the assets of shown regions, each where a document first shows it.

    In layout regions they stand at their anchor's row, after its text; those without
    one after the clusters of rows, in order, the rest at the last; without texts at
    the end.
    """
    asked = regions.select(*REGION, "mode", F.posexplode("asset_ids").alias("seq", "asset_id"))
    own = parts.assets.select("doc", F.col("idx").alias("of"), "asset_id", "asset_type", "uri", F.coalesce(F.nullif("description", F.lit("")), "asset_id").alias("label"), F.coalesce("anchor", "range", "cell").alias("anchor"), F.try_variant_get("metadata", "$.source_kind", "string").alias("source_kind"), F.try_variant_get("metadata", "$.anchor_row", "int").alias("hint"))
    # A sheet's asset goes before the document's of the same name.
    found = asked.join(own, ["doc", "asset_id"]).where(F.col("of").isNull() | (F.col("of") == F.col("idx")))
    found = found.withColumn("pick", F.row_number().over(Window.partitionBy(*REGION, "seq").orderBy(F.col("of").isNull(), "uri"))).where("pick = 1")
    found = found.where((F.col("mode") != "screenshot") | (F.col("source_kind") == "region_screenshot"))
    row = F.coalesce(F.regexp_extract("anchor", r"^[A-Za-z]*(\d+)", 1).try_cast("int"), F.col("hint"))
    found = found.withColumn("at", F.when(F.col("mode") == "layout", row)).withColumn("free", F.row_number().over(Window.partitionBy(*REGION, (F.col("mode") == "layout") & F.col("at").isNull()).orderBy("seq")) - 1)
    texts = content.where(F.col("form") == "list").join(regions.where(F.col("mode") == "layout").select(*REGION), REGION, "left_semi").select(*REGION, "row").distinct()
    order = Window.partitionBy(*REGION).orderBy("row")
    cluster = F.sum(F.coalesce((F.col("row") - F.lag("row").over(order) > GAP).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = texts.withColumn("c", cluster).groupBy(*REGION, "c").agg(F.max("row").alias("end"))
    ends = ends.groupBy(*REGION).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "end"))), lambda x: x["end"]).alias("ends"))
    placed = found.join(ends, REGION, "left")
    slot = F.coalesce(F.get("ends", F.least(F.col("free"), F.size("ends") - 1)), F.lit(10**9) + F.col("free"))
    placed = placed.withColumns({"part": F.when(F.col("mode") == "layout", BODY).otherwise(ASSETS), "row": F.when(F.col("mode") == "layout", F.coalesce("at", slot)).otherwise(0)})
    first = Window.partitionBy("doc", "asset_id").orderBy("idx", "ord", "part", "row", "seq")
    return placed.withColumn("turn", F.row_number().over(first)).where("turn = 1").select(*REGION, "part", "row", F.lit(1).alias("k"), "seq", F.col("asset_type").isin(*PICTURES).alias("picture"), "label", asset_uri(F.col("uri"), F.lit(folder)).alias("uri"))


def _line(df: DataFrame, place: list, content: Column) -> DataFrame:
    """(doc, ord, content): place is idx, ord, part, n, row and k; short ones are filled up with 0."""
    at = [F.lit(p) if isinstance(p, int) else F.col(p) for p in [*place, *[0] * (7 - len(place))]]
    return df.select("doc", F.struct(*[a.cast("int").alias(f"p{i}") for i, a in enumerate(at)]).alias("ord"), content.alias("content"))


def _html_rows(parts: Parts, tables: DataFrame) -> DataFrame:
    """(TABLE, row, content): rows of merged tables, without covered cells, each with its cell's address."""
    cells = parts.cells.join(tables.select(*TABLE, "top", "header_rows"), TABLE).select(*TABLE, "row", "col", cell_text(F.col("display"), F.col("raw")).alias("text"), "merged_master", "row_span", "col_span", "top", "header_rows")
    covers = _logical(parts).select(*TABLE, "row", "col", "own")
    own = cells.join(covers, [*TABLE, "row", "col"]).where(F.col("merged_master").isNull())
    # A cell without a master of its own may still lie inside another one's span.
    wide = own.where((F.col("row_span") > 1) | (F.col("col_span") > 1)).select(*TABLE, F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), "col_span")
    inside = wide.join(own.select(*TABLE, "row", "col"), [*TABLE, "row"]).where(F.col("col").between(F.col("c0"), F.col("c0") + F.col("col_span") - 1) & ((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))))
    own = own.join(inside.select(*TABLE, "row", "col").distinct(), [*TABLE, "row", "col"], "left_anti")
    tag = F.when(F.col("row") < F.col("top") + F.col("header_rows"), "th").otherwise("td")
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    item = F.concat(F.lit("    <"), tag, span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(' data-source-cell="'), address(F.col("row"), F.col("col")), F.lit('">'), F.replace(html_escape(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</"), tag, F.lit(">\n"))
    rows = own.select(*TABLE, "row", "col", item.alias("item")).groupBy(*TABLE, "row").agg(F.array_sort(F.collect_list(F.struct("col", "item"))).alias("x"))
    return rows.select(*TABLE, "row", F.concat(F.lit("  <tr>\n"), F.array_join(F.transform("x", lambda x: x["item"]), ""), F.lit("  </tr>\n")).alias("content"))


def _framed(tables: DataFrame, before: Column, after: Column) -> list[DataFrame]:
    return [_line(tables, ["idx", "ord", BODY, "n", -1], before), _line(tables, ["idx", "ord", BODY, "n", LAST], after)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown(parts: Parts, folder: str = "/") -> DataFrame:
    """(doc, ord, content): each document's Markdown in pieces; links of assets are seen from folder.

    Regions that parsing didn't recognise, empty ones, and tables without text are
    left out; an asset is shown once.
    """
    content = content_rows(parts)
    regions = shown_regions(parts, content)
    tables_mode = regions.where(F.col("mode") == "tables").select(*REGION, F.lit(True).alias("by_table"))
    rows = content.join(tables_mode, REGION, "left_semi")
    full = forms(parts).join(rows.select(*TABLE).distinct(), TABLE, "left_semi")
    several = parts.tables.groupBy(*REGION).count()
    full = full.join(several, REGION)
    pipes = lambda texts: F.concat(F.lit("| "), F.array_join(F.transform(texts, escape), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size("cols")), " | "), F.lit(" |\n"))
    title = F.when(F.col("count") > 1, F.concat(F.lit("#### "), "table_id", F.lit("\n\n"))).otherwise("")
    banner = _banner()
    group = F.concat(F.array(F.concat(F.lit("**"), escape(banner), F.lit("**"))), F.array_repeat(F.lit(""), F.size("cols") - 1))
    compact = F.when(banner.isNotNull(), F.concat(F.lit("| "), F.array_join(group, " | "), F.lit(" |\n"))).otherwise(pipes("texts"))
    raw = parts.cells.select(*TABLE, "row", "col", cell_text(F.col("display"), F.col("raw")).alias("text"), address(F.col("row"), F.col("col")).alias("own"))
    grid = _aligned(raw, full.where(F.col("form") == "grid").drop("count")).where((F.col("row") == F.col("top")) | F.exists("texts", lambda t: t != ""))
    of = lambda form: full.where(F.col("form") == form)
    body = lambda df, text: _line(df, ["idx", "ord", BODY, "n", "row"], text)
    layout = content.where(F.col("form") == "list").join(regions.where(F.col("mode") == "layout").select(*REGION), REGION, "left_semi")
    said = F.transform("pairs", lambda p: F.concat(F.lit("- **"), p["key"], F.lit("**: "), p["text"], F.lit("\n")))
    asset = F.concat(F.when(F.col("picture"), "![").otherwise("["), escape(F.col("label")), F.lit("]("), "uri", F.lit(")\n\n"))
    return _union([
        _line(parts.heads, [-1], F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))),
        _line(parts.sheets, ["idx", -1], F.concat(F.lit("## "), F.coalesce("name", F.lit("")), F.lit("\n\n"))),
        _line(regions.where(F.col("heading") != ""), ["idx", "ord", HEAD], F.concat(F.lit("### "), "heading", F.lit("\n\n"))),
        _line(regions.where(F.size("pairs") > 0), ["idx", "ord", PAIRS], F.concat(F.array_join(said, ""), F.lit("\n"))),
        body(rows.where(F.col("form") == "list"), F.concat(F.lit("- "), escape(_listed()), F.lit("\n"))), body(rows.where(F.col("form") == "compact"), compact),
        body(grid, F.concat(pipes("texts"), F.when(F.col("row") == F.col("top"), rule).otherwise(""))), body(_html_rows(parts, of("html")), F.col("content")),
        *_framed(of("list"), title, F.lit("\n")), *_framed(of("grid"), title, F.lit("\n")), *_framed(of("compact"), F.concat(title, pipes("labels"), rule), F.lit("\n")),
        *_framed(of("html"), F.concat(title, F.lit('<table class="sheet-table">\n')), F.lit("</table>\n\n")),
        _line(layout, ["idx", "ord", BODY, 0, "row", 0, "n"], F.concat(F.lit("- "), escape(_listed()), F.lit("\n\n"))),
        _line(asset_places(parts, regions, content, folder), ["idx", "ord", "part", 0, "row", "k", "seq"], asset),
    ])


def _anchor(text: Column, fallback: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(text, r"[^0-9A-Za-z_-]+", "-"), r"^-+|-+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), fallback.cast("string"))


def html(parts: Parts, folder: str = "/") -> DataFrame:
    """(doc, ord, content): each document as HTML in pieces: a list of contents, then sections; see markdown() for what is shown."""
    content = content_rows(parts)
    regions = shown_regions(parts, content)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("idx")) - 1
    sheets = parts.sheets.withColumn("i", place).select("doc", "idx", F.coalesce("name", F.lit("")).alias("name"), F.concat(F.lit("sheet-"), F.col("i").cast("string"), F.lit("-"), _anchor(F.coalesce("sheet_id", F.lit("")), F.col("i"))).alias("anchor"))
    named = regions.join(sheets.select("doc", "idx", "anchor"), ["doc", "idx"]).withColumn("anchor", F.concat("anchor", F.lit("-region-"), F.col("ord").cast("string"), F.lit("-"), _anchor(F.col("region_id"), F.col("ord"))))
    rows = content.join(regions.where(F.col("mode") == "tables").select(*REGION), REGION, "left_semi")
    full = forms(parts).join(rows.select(*TABLE).distinct(), TABLE, "left_semi")
    merged = full.where(F.col("form").isin("html", "grid"))
    cells = lambda tag, texts: F.array_join(F.transform(texts, lambda t: F.concat(F.lit(f"<{tag}>"), html_escape(t), F.lit(f"</{tag}>"))), "")
    banner = _banner()
    compact = F.when(banner.isNotNull(), F.concat(F.lit('<tr><td colspan="'), F.size("cols").cast("string"), F.lit('"><strong>'), html_escape(banner), F.lit("</strong></td></tr>"))).otherwise(F.concat(F.lit("<tr>"), cells("td", "texts"), F.lit("</tr>")))
    body = lambda df, text: _line(df, ["idx", "ord", BODY, "n", "row"], text)
    layout = content.where(F.col("form") == "list").join(regions.where(F.col("mode") == "layout").select(*REGION), REGION, "left_semi")
    label, uri = html_escape(F.col("label")), html_escape(F.col("uri"))
    picture = F.concat(F.lit('<figure><img src="'), uri, F.lit('" alt="'), label, F.lit('" loading="lazy"><figcaption>'), label, F.lit("</figcaption></figure>"))
    asset = F.when(F.col("picture"), picture).otherwise(F.concat(F.lit('<p class="asset"><a href="'), uri, F.lit('">'), label, F.lit("</a></p>")))
    said = F.transform("pairs", lambda p: F.concat(F.lit("<dt>"), html_escape(p["key"]), F.lit("</dt><dd>"), html_escape(p["text"]), F.lit("</dd>")))
    title = html_escape(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>'), title, F.lit(f"</title><style>{STYLE}</style></head><body><nav><ol>"))
    link = lambda text: F.concat(F.lit('<li><a href="#'), "anchor", F.lit('">'), html_escape(text), F.lit("</a>"))
    shown = named.where(F.col("heading") != "")
    # The list of contents stands at idx -2: its places are those of the sections, one level down.
    return _union([
        _line(parts.heads, [-3], head), _line(parts.heads, [-1], F.concat(F.lit("</ol></nav><main><h1>"), title, F.lit("</h1>"))), _line(parts.heads, [LAST], F.lit("</main></body></html>\n")),
        _line(sheets, [-2, "idx", -1], F.concat(link(F.col("name")), F.lit("<ol>"))), _line(sheets, [-2, "idx", LAST], F.lit("</ol></li>")), _line(shown, [-2, "idx", 0, "ord"], F.concat(link(F.col("heading")), F.lit("</li>"))),
        _line(sheets, ["idx", -1], F.concat(F.lit('<section id="'), "anchor", F.lit('"><h2>'), html_escape(F.col("name")), F.lit("</h2>"))), _line(sheets, ["idx", LAST], F.lit("</section>")),
        _line(named, ["idx", "ord", HEAD], F.concat(F.lit('<section id="'), "anchor", F.lit('" data-region-type="'), "region_type", F.lit('">'), F.when(F.col("heading") != "", F.concat(F.lit("<h3>"), html_escape(F.col("heading")), F.lit("</h3>"))).otherwise(""))),
        _line(named, ["idx", "ord", TAIL], F.lit("</section>")),
        _line(regions.where(F.size("pairs") > 0), ["idx", "ord", PAIRS], F.concat(F.lit('<dl class="metadata">'), F.array_join(said, ""), F.lit("</dl>"))),
        body(rows.where(F.col("form") == "list"), F.concat(F.lit("<li>"), html_escape(_listed()), F.lit("</li>"))), body(rows.where(F.col("form") == "compact"), compact), body(_html_rows(parts, merged), F.col("content")),
        *_framed(full.where(F.col("form") == "list"), F.lit('<div class="table-wrap"><ul>'), F.lit("</ul></div>")),
        *_framed(full.where(F.col("form") == "compact"), F.concat(F.lit('<div class="table-wrap"><table><tr>'), cells("th", "labels"), F.lit("</tr>")), F.lit("</table></div>")),
        *_framed(merged, F.lit('<div class="table-wrap"><table class="sheet-table">\n'), F.lit("</table></div>")),
        _line(layout, ["idx", "ord", BODY, 0, "row", 0, "n"], F.concat(F.lit("<p>"), html_escape(_listed()), F.lit("</p>"))),
        _line(asset_places(parts, regions, content, folder), ["idx", "ord", "part", 0, "row", "k", "seq"], asset),
    ])
