"""What goes into files: rows (file, ord, content) for gridloom.sources.files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import html_escape, safe_name, strip
from gridloom.functions.times import clock, srt_time
from gridloom.operators import captions
from gridloom.operators.grid import SHEET, dense_rows
from gridloom.operators.render import csv_rows

#: Formats of sheets (fixed values): the number they are asked for by, and the ending.
FORMATS = {"1": "md", "2": "csv", "3": "html", "markdown": "md", "md": "md", "csv": "csv", "html": "html", "htm": "html"}
HTML_HEAD = '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>Sheet</title>\n</head>\n<body>\n<table border="1">\n'
HTML_TAIL = "</tbody></table></body></html>"


def sheet_files(sheets: DataFrame, ending: str) -> DataFrame:
    """(doc, sheet, file): book_sheet.ending, below the folder of the book; equal names, case ignored, get _1, _2 and so on."""
    stem = F.regexp_replace(F.element_at(F.split("doc", "/"), -1), r"\.[^.]*$", "")
    rows = sheets.select(*SHEET).distinct().withColumn("base", F.concat(safe_name(stem), F.lit("_"), safe_name(F.col("sheet"))))
    place = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("doc", "sheet")) - 1
    return rows.withColumn("n", place).select(*SHEET, F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(f".{ending}")).alias("file"))


def _fitted(texts: Column, width: Column) -> Column:
    """The texts of a row, padded or cut to the header's number."""
    return F.slice(F.concat(texts, F.array_repeat(F.lit(""), F.greatest(width - F.size(texts), F.lit(0)))), F.lit(1), width)


def sheet_contents(cells: DataFrame, kind: str) -> DataFrame:
    """(file, ord, content) of every sheet as one file of the kind (see FORMATS): the first row is the header.

    CSV has CRLF line ends and belongs behind a byte-order mark. Rows are padded or
    cut to the header's width in Markdown and HTML.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {sorted(FORMATS)}")
    ending = FORMATS[kind]
    names = sheet_files(cells, ending)
    if ending == "csv":
        lines = csv_rows(cells).select(*SHEET, F.col("row").alias("ord"), F.concat("line", F.lit("\r\n")).alias("content"))
        return lines.join(names, SHEET).select("file", "ord", "content")
    rows = dense_rows(cells)
    top = rows.groupBy(*SHEET).agg(F.min("row").alias("top"), F.min_by(F.size("texts"), "row").alias("width"), F.max("row").alias("bottom"))
    rows = rows.join(top, SHEET)
    texts, first = _fitted(F.col("texts"), F.col("width")), F.col("row") == F.col("top")
    if ending == "md":
        flat = lambda t: F.replace(F.replace(F.replace(t, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
        line = F.concat(F.lit("| "), F.array_join(F.transform(texts, flat), " | "), F.lit(" |\n"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |\n"))
        content = F.concat(line, F.when(first, rule).otherwise(""))
    else:
        cell = lambda tag: F.array_join(F.transform(texts, lambda t: F.concat(F.lit(f"<{tag}>"), html_escape(t), F.lit(f"</{tag}>\n"))), "")
        head = F.concat(F.lit(HTML_HEAD), F.lit("<thead><tr>\n"), cell("th"), F.lit("</tr></thead><tbody>\n"))
        body = F.concat(F.lit("<tr>\n"), cell("td"), F.lit("</tr>\n"))
        content = F.concat(F.when(first, head).otherwise(body), F.when(F.col("row") == F.col("bottom"), F.lit(HTML_TAIL)).otherwise(""))
    return rows.select(*SHEET, F.col("row").alias("ord"), content.alias("content")).join(names, SHEET).select("file", "ord", "content")


def _seconds(ms: Column) -> Column:
    return F.round(ms / 1_000.0, 3)


def _json_list(rows: DataFrame, item: Column, number: Column) -> DataFrame:
    """(session, ord, content): the lines of a JSON array; each row is one line, so no array is held."""
    n = F.count("*").over(Window.partitionBy("session"))
    text = F.concat(F.when(number == 1, "[\n").otherwise(""), F.to_json(item, {"ignoreNullFields": "false"}), F.when(number == n, "\n]\n").otherwise(",\n"))
    return rows.select("session", number.alias("ord"), text.alias("content"))


def transcript_files(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """(file, ord, content): for each session transcript.json, .txt and .srt, session.json, and translation.srt if anything was translated.

    Cues are numbered anew in each file. A session without confirmed texts has an
    empty array, and empty texts.
    """
    rows, done = captions.persisted(segments), captions.translated(segments).where(F.col("status") == "Translated")
    number = F.row_number().over(Window.partitionBy("session").orderBy("seq", "id"))
    item = F.struct(
        "id", "session", F.col("seq").alias("sequenceNumber"), _seconds(F.col("start_ms")).alias("start"), _seconds(F.col("end_ms")).alias("end"),
        "language", "text", "translation", "status",
    )
    own = sessions.select("session").distinct()
    empty = own.join(rows.select("session").distinct(), "session", "left_anti")
    folder = F.col("session").cast("string")
    at = lambda df, name: df.select(F.concat(folder, F.lit(f"/{name}")).alias("file"), "ord", "content")
    cue = lambda df, text: captions.srt(df, text).select("session", F.col("idx").alias("ord"), F.col("cue").alias("content"))
    facts = captions.session_document(sessions, segments).join(rows.groupBy("session").agg(F.count("*").alias("shown")), "session", "left").join(done.groupBy("session").agg(F.count("*").alias("done")), "session", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    document = F.struct(
        "session", "state", F.col("language").alias("recognitionLanguage"), count(F.col("shown")).alias("segmentCount"), count(F.col("done")).alias("translatedCount"),
        F.col("translation_enabled").alias("translationEnabled"), F.col("source").alias("translationSource"), F.col("target").alias("translationTarget"),
    )
    parts = [
        at(_json_list(rows, item, number), "transcript.json"), at(captions.txt(rows).select("session", F.col("idx").alias("ord"), F.col("line").alias("content")), "transcript.txt"),
        at(cue(rows, "text"), "transcript.srt"), at(cue(done, "translation"), "translation.srt"),
        at(facts.select("session", F.lit(1).alias("ord"), F.concat(F.to_json(document, {"ignoreNullFields": "false"}), F.lit("\n")).alias("content")), "session.json"),
        *(at(empty.select("session", F.lit(1).alias("ord"), F.lit(text).alias("content")), name) for name, text in (("transcript.json", "[]\n"), ("transcript.txt", ""), ("transcript.srt", ""))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corrected_files(captions_again: DataFrame) -> DataFrame:
    """(file, ord, content): corrected-transcript.json, .txt and .srt of a second pass (session, start_ms, end_ms, text, confidence), numbered by start.

    Texts stay as they are; nothing of the first pass is touched.
    """
    number = F.row_number().over(Window.partitionBy("session").orderBy("start_ms", "end_ms", "text"))
    rows = captions_again.select("session", number.alias("n"), "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"), "confidence")
    item = F.struct(F.col("n").alias("sequenceNumber"), _seconds(F.col("start_ms")).alias("start"), _seconds(F.col("end_ms")).alias("end"), "text", "confidence")
    folder = F.col("session").cast("string")
    at = lambda df, name: df.select(F.concat(folder, F.lit(f"/corrected-transcript.{name}")).alias("file"), "ord", "content")
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), "text", F.lit("\n"))
    cue = F.concat(F.col("n").cast("string"), F.lit("\r\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\r\n"), "text", F.lit("\r\n\r\n"))
    text = lambda c: rows.select("session", F.col("n").alias("ord"), c.alias("content"))
    return at(_json_list(rows, item, F.col("n")), "json").unionByName(at(text(line), "txt")).unionByName(at(text(cue), "srt"))


def asset_files(assets: DataFrame) -> DataFrame:
    """(file, content): the pictures of ASSETS rows, one file each below the folder of their book.

    The name is the sheet's and the picture's number, the ending that of the media part.
    """
    stem = F.regexp_replace(F.element_at(F.split("doc", "/"), -1), r"\.[^.]*$", "")
    ending = F.lower(F.coalesce(F.nullif(F.regexp_extract("uri", r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("bin")))
    name = F.concat(safe_name(stem), F.lit("/"), safe_name(F.col("sheet")), F.lit("_"), F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit("."), ending)
    return assets.where(F.col("content").isNotNull()).select(name.alias("file"), "content")


def summary_files(contents: DataFrame, name: str = "meeting-summary.md") -> DataFrame:
    """(file, content) of summaries (session, content)."""
    return contents.select(F.concat(F.col("session").cast("string"), F.lit(f"/{name}")).alias("file"), "content")


def preview_rows(cells: DataFrame, merges: DataFrame, rows: int = 41, columns: int = 21) -> DataFrame:
    """(doc, sheet, row, line): the first rows and columns of each sheet from its first cell on, as HTML rows without covered cells."""
    from gridloom.operators.render import html_rows

    first = cells.groupBy(*SHEET).agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    near = cells.join(first, SHEET).where((F.col("row") < F.col("r0") + rows) & (F.col("col") < F.col("c0") + columns)).drop("r0", "c0")
    return html_rows(near, merges).select(*SHEET, "row", "line")


def inspection_files(cells: DataFrame, merges: DataFrame, samples: int = 80, headers: int = 40) -> DataFrame:
    """(file, ord, content): workbook.json, sheets/<sheet>.json, preview/<sheet>.html and index.json of each book.

    A sheet's file has its counts, its first texts by place, and those of the first
    20 rows that may be headers (40 characters at most, each once).
    """
    stem = F.regexp_replace(F.element_at(F.split("doc", "/"), -1), r"\.[^.]*$", "")
    folder = F.concat(safe_name(stem), F.lit("/"))
    full = cells.where(strip(F.coalesce("display", F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row", "col"))
    early = full.select(*SHEET, "row", "col", "display").withColumn("n", place).where(F.col("n") <= samples)
    shown = early.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("n", "row", "col", F.col("display").alias("value")))).alias("s"))
    fit = F.filter("s", lambda x: (x["row"] <= 20) & (F.length(x["value"]) <= 40))
    counts = cells.groupBy(*SHEET).agg(F.count("*").alias("cell_count"), F.count_if(strip(F.coalesce("display", F.lit(""))) != "").alias("nonblank_count"))
    spans = merges.groupBy(*SHEET).agg(F.count("*").alias("merges"))
    sheets = counts.join(shown, SHEET, "left").join(spans, SHEET, "left").select(
        *SHEET, "cell_count", "nonblank_count", F.coalesce("merges", F.lit(0)).alias("merge_hint_count"),
        F.transform(F.coalesce("s", F.array().cast("array<struct<n:int,row:int,col:int,value:string>>")), lambda x: F.struct(x["row"].alias("row"), x["col"].alias("column"), x["value"].alias("value"))).alias("sample_values"),
        F.slice(F.array_distinct(F.transform(F.coalesce(fit, F.array().cast("array<struct<n:int,row:int,col:int,value:string>>")), lambda x: x["value"])), 1, headers).alias("header_candidates"),
    )
    name = safe_name(F.col("sheet"))
    own = sheets.select(F.concat(folder, F.lit("sheets/"), name, F.lit(".json")).alias("file"), F.lit(0).alias("ord"), F.concat(F.to_json(F.struct(F.col("sheet").alias("name"), *sheets.columns[2:])), F.lit("\n")).alias("content"))
    short = F.struct(F.col("sheet").alias("name"), "nonblank_count", "cell_count", "merge_hint_count")
    book = sheets.groupBy("doc").agg(F.array_sort(F.collect_list(short)).alias("sheets"))
    whole = book.select(F.concat(folder, F.lit("workbook.json")).alias("file"), F.lit(0).alias("ord"), F.concat(F.to_json(F.struct(F.col("doc").alias("source"), F.size("sheets").alias("sheet_count"), "sheets")), F.lit("\n")).alias("content"))
    files = F.transform("sheets", lambda s: F.struct(s["name"].alias("name"), F.concat(F.lit("sheets/"), safe_name(s["name"]), F.lit(".json")).alias("summary"), F.concat(F.lit("preview/"), safe_name(s["name"]), F.lit(".html")).alias("preview")))
    index = book.select(F.concat(folder, F.lit("index.json")).alias("file"), F.lit(0).alias("ord"), F.concat(F.to_json(F.struct(F.lit("workbook.json").alias("workbook"), files.alias("sheets"))), F.lit("\n")).alias("content"))
    lines = preview_rows(cells, merges)
    edge = lines.groupBy(*SHEET).agg(F.min("row").alias("a"), F.max("row").alias("b"))
    html = lines.join(edge, SHEET).select(
        F.concat(folder, F.lit("preview/"), name, F.lit(".html")).alias("file"), F.col("row").alias("ord"),
        F.concat(F.when(F.col("row") == F.col("a"), F.lit("<!DOCTYPE html>\n<table>\n")).otherwise(""), "line", F.lit("\n"), F.when(F.col("row") == F.col("b"), F.lit("</table>\n")).otherwise("")).alias("content"),
    )
    return own.unionByName(whole).unionByName(index).unionByName(html)


