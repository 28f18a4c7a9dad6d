"""XLSX workbooks as relations: cells, merges, assets, texts of drawings and diagnostics.

Files are read by Spark; each is parsed in a task, with the standard library only.
gridloom.sources.workbooks reads all relations at once.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schemas import ASSETS, CELLS, DIAGNOSTICS, MERGES, TEXTS

SUFFIXES = r"(?i)\.(xlsx|xlsm|xltx|xltm)$"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_DEFAULT_NAME = re.compile(r"^(?:Picture|Shape|Image|TextBox)\s*\d*$", re.I)
_MERGE = re.compile(rb"""<(?:\w+:)?mergeCell\s[^>]*?ref=["']([^"']*)["']""")
_ADDRESS = re.compile(r"^([A-Z]+)(\d+)$")


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of the workbooks below the paths; lock files (~$) are left out, a path counts once."""
    files = None
    for p in paths:
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "content")
        files = own if files is None else files.unionByName(own)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(F.col("path").rlike(SUFFIXES) & ~name.startswith("~$")).dropDuplicates(["path"])


def _address(text: str) -> tuple[int, int]:
    letters, digits = _ADDRESS.match(text).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _relations(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """id to part, external targets left out."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in book.namelist():
        return {}
    found = {}
    for r in ElementTree.fromstring(book.read(name)):
        if r.get("TargetMode") != "External":
            target = r.get("Target")
            found[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))
    return found


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str | None]]:
    """(name, part) of the sheets in order."""
    links = _relations(book, "xl/workbook.xml")
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), links.get(s.get(f"{_REL}id"))) for s in root.iter(f"{_MAIN}sheet")]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _color(element: ElementTree.Element | None) -> dict:
    """rgb, theme, tint and indexed of a colour, as far as given."""
    if element is None:
        return {}
    number = lambda name: {name: float(element.get(name)) if name == "tint" else int(element.get(name))} if element.get(name) else {}
    return ({"rgb": element.get("rgb")} if element.get("rgb") else {}) | number("theme") | number("tint") | number("indexed")


def _font(f: ElementTree.Element) -> dict:
    text = {k: e.get("val") for k, tag in (("name", "name"), ("underline", "u")) if (e := f.find(f"{_MAIN}{tag}")) is not None and (e.get("val") or tag == "u")}
    if "underline" in text:
        text["underline"] = text["underline"] or "single"
    size = f.find(f"{_MAIN}sz")
    flags = {k: True for k, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike")) if (e := f.find(f"{_MAIN}{tag}")) is not None and e.get("val", "1") not in ("0", "false")}
    color = _color(f.find(f"{_MAIN}color"))
    return text | flags | ({"size": float(size.get("val"))} if size is not None and size.get("val") else {}) | ({"color": color} if color else {})


def _fill(f: ElementTree.Element) -> dict:
    pattern = f.find(f"{_MAIN}patternFill")
    if pattern is None or pattern.get("patternType", "none") == "none":
        return {}
    colors = {k: c for k, tag in (("foreground", "fgColor"), ("background", "bgColor")) if (c := _color(pattern.find(f"{_MAIN}{tag}")))}
    return {"pattern": pattern.get("patternType"), **colors}


def _border(b: ElementTree.Element) -> dict:
    sides = {}
    for side in ("left", "right", "top", "bottom"):
        e = b.find(f"{_MAIN}{side}")
        if e is not None and e.get("style"):
            color = _color(e.find(f"{_MAIN}color"))
            sides[side] = {"style": e.get("style"), **({"color": color} if color else {})}
    return sides


@dataclass(frozen=True)
class Style:
    bold: bool = False
    date: bool = False
    json: str | None = None


def _shows_date(number: int, code: str) -> bool:
    return 14 <= number <= 22 or 45 <= number <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code).lower()))


def _styles(book: zipfile.ZipFile) -> list[Style]:
    """The cell styles: what differs from a plain cell, as JSON with sorted keys."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    each = lambda path, of: [of(e) for e in root.findall(path)]
    fonts, fills, borders = each(f"{_MAIN}fonts/{_MAIN}font", _font), each(f"{_MAIN}fills/{_MAIN}fill", _fill), each(f"{_MAIN}borders/{_MAIN}border", _border)
    formats = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{_MAIN}numFmt")}
    out = []
    for x in root.findall(f"{_MAIN}cellXfs/{_MAIN}xf"):
        at = lambda kind, known: known[i] if (i := int(x.get(kind, 0))) < len(known) else {}  # noqa: B023, E731
        number, alignment = int(x.get("numFmtId", 0)), x.find(f"{_MAIN}alignment")
        parts = {"font": at("fontId", fonts), "fill": at("fillId", fills), "border": at("borderId", borders), "alignment": {} if alignment is None else dict(alignment.attrib), "number_format": formats.get(number, "")}
        told = {k: v for k, v in parts.items() if v}
        out.append(Style(bool(parts["font"].get("bold")), _shows_date(number, formats.get(number, "")), json.dumps(told, ensure_ascii=False, sort_keys=True) if told else None))
    return out


def _date(serial: float) -> str:
    at = pd.Timestamp("1899-12-30") + pd.Timedelta(days=serial)
    return at.strftime("%Y-%m-%d") if serial == int(serial) else at.round("s").strftime("%Y-%m-%d %H:%M:%S")


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


class _Merges:
    """The merges of a sheet: masters and spans by cell; wide ones are not spread out."""

    MOST = 4_096

    def __init__(self, references: list[str]):
        self.boxes, self.spans, self.masters, self.wide = [], {}, {}, []
        for reference in references:
            first, _, last = reference.partition(":")
            (r0, c0), (r1, c1) = _address(first), _address(last or first)
            self.boxes.append((r0, c0, r1, c1))
            self.spans[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            if (r1 - r0 + 1) * (c1 - c0 + 1) > self.MOST:
                self.wide.append((first, r0, c0, r1, c1))
            else:
                self.masters |= {(r, c): first for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}

    def master(self, row: int, col: int) -> str | None:
        if (row, col) in self.spans:
            return None
        found = self.masters.get((row, col))
        return found or next((first for first, r0, c0, r1, c1 in self.wide if r0 <= row <= r1 and c0 <= col <= c1), None)


def _cell(c: ElementTree.Element, strings: list[str], styles: list[Style]) -> tuple[str | None, str | None, str, Style, str | None]:
    """(shown, formula, type, style, problem) of a cell; what can't be read is shown as it stands and told."""
    kind, number = c.get("t", "n"), c.get("s", "0")
    style = styles[int(number)] if number.isdigit() and int(number) < len(styles) else Style()
    value, formula = c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f")
    data_type, problem = "string" if kind in ("s", "str", "inlineStr") else "error" if kind == "e" else "number", None
    shown = value
    if kind == "inlineStr":
        shown = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    elif kind == "s" and value is not None:
        known = value.strip().isdigit() and int(value) < len(strings)
        shown, problem = (strings[int(value)], None) if known else (None, f"cell.string-missing:{value}")
    elif kind == "b" and value is not None:
        shown, data_type = ("TRUE" if value == "1" else "FALSE"), "boolean"
    elif data_type == "number" and value is not None:
        try:
            shown, data_type = (_date(float(value)), "date") if style.date else (_number(value), "number")
        except (ValueError, OverflowError):
            data_type, problem = "string", f"cell.number-invalid:{value}"
    text = None if formula is None else formula if formula.startswith("=") else f"={formula}"
    return shown, text, "blank" if shown is None and text is None else data_type, style, problem


def parse_book(doc: str, book: zipfile.ZipFile) -> Iterator[tuple[str, tuple]]:
    """(part, row) of all relations of a workbook in one reading: cell, merge, asset, text and diagnostic.

    A sheet's cells are read one by one, so only strings, styles and merges are held. A
    part or a cell that can't be read is a diagnostic, and the rest goes on.
    """
    names = set(book.namelist())

    def told(code: str, severity: str, message: str, sheet: str | None = None, cell: str | None = None) -> tuple[str, tuple]:
        return "diagnostic", (doc, code, severity, message, sheet, cell)

    try:
        sheets = sheet_parts(book)
    except (ElementTree.ParseError, KeyError) as error:
        yield told("workbook.unreadable", "error", str(error))
        return
    shared: list = []
    for what, reader in (("strings", _strings), ("styles", _styles)):
        try:
            shared.append(reader(book))
        except (ElementTree.ParseError, ValueError, zipfile.BadZipFile) as error:
            shared.append([])
            yield told(f"workbook.{what}-unreadable", "error", str(error))
    strings, styles = shared
    for sheet, part in sheets:
        if part is None or part not in names:
            yield told("sheet.part-missing", "error", f"no part for sheet {sheet}", sheet)
            continue
        try:
            yield from _sheet_rows(doc, sheet, book, part, strings, styles, told)
        except (ElementTree.ParseError, zipfile.BadZipFile, UnicodeDecodeError) as error:
            yield told("sheet.unreadable", "error", str(error), sheet)
        try:
            found, texts, problems = _drawings(doc, sheet, book, part)
        except (ElementTree.ParseError, zipfile.BadZipFile, ValueError) as error:
            yield told("drawing.unreadable", "warning", str(error), sheet)
            continue
        yield from (("asset", x) for x in found)
        yield from (("text", x) for x in texts)
        yield from (("diagnostic", x) for x in problems)


def _sheet_rows(doc: str, sheet: str, book: zipfile.ZipFile, part: str, strings: list[str], styles: list[Style], told) -> Iterator[tuple[str, tuple]]:
    with book.open(part) as raw:
        references = [m.decode() for m in _MERGE.findall(raw.read())]
    good = [r for r in references if re.fullmatch(r"[A-Z]+\d+(?::[A-Z]+\d+)?", r)]
    merges = _Merges(good)
    yield from (("merge", (doc, sheet, *box)) for box in merges.boxes)
    yield from (told("merge.invalid", "warning", r, sheet) for r in references if r not in good)
    row = col = 0
    with book.open(part) as raw:
        for event, e in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                if e.tag == f"{_MAIN}row":
                    row, col = int(e.get("r")) if (e.get("r") or "").isdigit() else row + 1, 0
                continue
            if e.tag == f"{_MAIN}c":
                at = _ADDRESS.match(e.get("r") or "")
                row, col = _address(e.get("r")) if at else (row, col + 1)  # cells may leave out their address
                shown, formula, kind, style, problem = _cell(e, strings, styles)
                if problem:
                    yield told(problem.partition(":")[0], "warning", problem.partition(":")[2], sheet, _name(row, col))
                rows, cols = merges.spans.get((row, col), (1, 1))
                yield "cell", (doc, sheet, row, col, shown, formula or shown, formula, kind, style.bold, merges.master(row, col), rows, cols, style.json)
            if e.tag in (f"{_MAIN}c", f"{_MAIN}row"):
                e.clear()


def _drawings(doc: str, sheet: str, book: zipfile.ZipFile, part: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of ASSETS, numbered by kind in the order of their anchors; of TEXTS, each text once, first seen first; and of DIAGNOSTICS."""
    assets, texts, problems = [], {}, []
    for drawing in (t for t in _relations(book, part).values() if "/drawings/" in t and t.endswith(".xml")):
        if drawing not in book.namelist():
            problems.append((doc, "drawing.part-missing", "warning", drawing, sheet, None))
            continue
        links, found = _relations(book, drawing), []
        for anchor in ElementTree.fromstring(book.read(drawing)):
            at = [int(anchor.findtext(f"{_DRAW}{side}/{_DRAW}{axis}", "-1")) + 1 for side in ("from", "to") for axis in ("row", "col")]
            where = None if at[0] < 1 else _name(*at[:2]) if at[2] < 1 or at[:2] == at[2:] else f"{_name(*at[:2])}:{_name(*at[2:])}"
            for el in anchor:
                kind = {f"{_DRAW}pic": "image", f"{_DRAW}sp": "shape", f"{_DRAW}grpSp": "shape", f"{_DRAW}cxnSp": "shape"}.get(el.tag)
                if kind is None:
                    continue
                props = next(el.iter(f"{_DRAW}cNvPr"), None)
                alt = "" if props is None else (props.get("descr") or "").strip() or ("" if _DEFAULT_NAME.match(props.get("name") or "") else props.get("name") or "")
                blip = next(el.iter(f"{_ART}blip"), None)
                media = None if blip is None else links.get(blip.get(f"{_REL}embed"))
                lines = ["".join(t.text or "" for t in p.iter(f"{_ART}t")) for p in el.iter(f"{_ART}p")]
                text = "\n".join(lines).strip()
                if text:
                    texts.setdefault(text, len(texts))
                if kind == "image" and media not in book.namelist():
                    problems.append((doc, "asset.media-missing", "warning", str(media), sheet, where))
                    continue
                found.append((at[:2], kind, media, where, text or alt or None, book.read(media) if kind == "image" else None))
        numbers: dict[str, int] = {}
        for _, kind, media, where, alt, content in sorted(found, key=lambda x: x[0]):
            numbers[kind] = numbers.get(kind, 0) + 1
            assets.append((doc, sheet, f"{sheet}-{kind}-{numbers[kind]}", kind, media, where, alt, numbers[kind], content))
    return assets, [(doc, sheet, n, t) for t, n in texts.items()], problems


def _name(row: int, col: int) -> str:
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def rows_of(doc: str, content: bytes) -> Iterator[tuple[str, tuple]]:
    """parse_book() of a file's bytes; what is no workbook at all is one diagnostic."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            yield from parse_book(doc, book)
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError) as error:
        yield "diagnostic", (doc, "workbook.unreadable", "error", str(error), None, None)


def _parsed(files: DataFrame, schema: str, part: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([row for kind, row in rows_of(path, content) if kind == part], columns=names)

    return files.mapInPandas(run, schema)


def cells(files: DataFrame) -> DataFrame:
    return _parsed(files, CELLS, "cell")


def merges(files: DataFrame) -> DataFrame:
    return _parsed(files, MERGES, "merge")


def assets(files: DataFrame) -> DataFrame:
    return _parsed(files, ASSETS, "asset")


def drawing_texts(files: DataFrame) -> DataFrame:
    """Texts of shapes and pictures, each once for a sheet, in the order they are first seen."""
    return _parsed(files, TEXTS, "text")


def diagnostics(files: DataFrame) -> DataFrame:
    """What can't be read or isn't there; an unreadable workbook is one row, not a failure."""
    return _parsed(files, DIAGNOSTICS, "diagnostic")
