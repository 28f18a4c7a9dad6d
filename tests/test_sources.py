"""Workbooks, messages, audio files, the store and the caption stream."""

import base64
import json
import zipfile

from pyspark.sql import functions as F

from gridloom.operators import jobs, render
from gridloom.schemas import SEGMENTS, SESSIONS
from gridloom.sources import messages, xlsx
from gridloom.streaming.captions import captions_batch, captions_stream
from gridloom.streaming.store import Store

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAW = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path):
    """One sheet: a merged bold title, a formula without a cached value, a number, a date, a shape and a picture; and a sheet without a part."""
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="Items" sheetId="1" r:id="rId1"/><sheet name="Lost" sheetId="2" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Type="{KIND}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>Title</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {MAIN}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0" numFmtId="0"/><xf fontId="1" numFmtId="0"/><xf fontId="0" numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1"/></row><row r="2"><c r="A2"><f>SUM(B2:B3)</f></c><c r="B2" t="s"><v>1</v></c><c r="C2"><v>12.0</v></c><c r="D2" s="2"><v>45292</v></c><c r="E2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Type="{KIND}/drawing" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {DRAW}><xdr:twoCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>4</xdr:row></xdr:from><xdr:to><xdr:col>2</xdr:col><xdr:row>8</xdr:row></xdr:to><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="2" name="Shape 2"/></xdr:nvSpPr><xdr:txBody><a:p><a:r><a:t>first</a:t></a:r></a:p><a:p><a:r><a:t>second</a:t></a:r></a:p></xdr:txBody></xdr:sp></xdr:twoCellAnchor>'
        '<xdr:oneCellAnchor><xdr:from><xdr:col>3</xdr:col><xdr:row>1</xdr:row></xdr:from><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="3" name="Picture 1" descr="a login form"/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Type="{KIND}/image" Target="../media/image1.png"/></Relationships>',
        "xl/media/image1.png": "not really a picture",
    }
    with zipfile.ZipFile(path, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)


def test_workbook(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    workbook(tmp_path / "deep" / "book.xlsx")
    workbook(tmp_path / "~$book.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "notes.txt").write_text("x")
    files = xlsx.scan(spark, str(tmp_path), str(tmp_path / "deep"))
    assert sorted(r["path"].rpartition("/")[2] for r in files.collect()) == ["book.xlsx", "broken.xlsx"]
    cells = {(r["row"], r["col"]): r for r in xlsx.cells(files).collect()}
    assert cells[1, 1]["display"] == "Title" and cells[1, 1]["bold"] and cells[1, 1]["col_span"] == 2 and cells[1, 2]["merged_master"] == "A1"
    assert cells[2, 1]["display"] is None and cells[2, 1]["formula"] == "=SUM(B2:B3)" and cells[2, 2]["display"] == "two runs"
    assert [cells[2, c]["display"] for c in (3, 4, 5)] == ["12", "2024-01-01", "TRUE"] and [cells[2, c]["data_type"] for c in (3, 4, 5)] == ["number", "date", "boolean"]
    assert [tuple(r)[2:] for r in xlsx.merges(files).collect()] == [(1, 1, 1, 2)]
    assets = {r["asset_type"]: r for r in xlsx.assets(files).collect()}
    assert assets["shape"]["description"] == "first\nsecond" and assets["shape"]["anchor"] == "A5:C9"
    assert assets["image"]["description"] == "a login form" and assets["image"]["anchor"] == "D2" and bytes(assets["image"]["content"]) == b"not really a picture"
    assert sorted(r["code"] for r in xlsx.diagnostics(files).collect()) == ["sheet.part-missing", "workbook.unreadable"]


def test_messages_name_their_problem(spark):
    lines = ["{", "[1]", '{"v": 2, "type": "start"}', '{"v": 1, "type": "dance"}', '{"v": 1, "type": "start"}', '{"v": 1, "type": "start", "sessionId": "s"}', None]
    rows = spark.createDataFrame(list(enumerate(lines)), "i long, value string")
    got = [r["problem"] for r in messages.parse(rows).orderBy("i").collect()]
    assert got == ["json", "json", "version", "type", "missing:sessionId", None, "json"]
    pcm = [("!", 1), ("", 0), (base64.b64encode(b"abc").decode(), 1), (base64.b64encode(b"abcd").decode(), 3), (base64.b64encode(b"abcd").decode(), 2), (base64.b64encode(bytes(320_002)).decode(), None)]
    data = spark.createDataFrame([(i, *p) for i, p in enumerate(pcm)], "i long, pcm string, frames int")
    _, problem = messages.audio(F.col("pcm"), F.col("frames"))
    assert [r["p"] for r in data.select("i", problem.alias("p")).orderBy("i").collect()] == ["base64", "empty", "odd", "frames", None, "size"]


def test_wav_round_trip(spark, tmp_path):
    data = bytes(range(256)) * 300
    (tmp_path / "a.wav").write_bytes(messages.wav_bytes(data))
    (tmp_path / "b.wav").write_bytes(b"RIFFnope")
    rows = messages.wav(spark, str(tmp_path)).orderBy("ord").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == data and all(len(r["data"]) <= 32_000 for r in rows)
    assert [r["start_s"] for r in rows] == [0.0, 1.0, 2.0]


def test_manifest_and_dictionary(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"manifest_version": "1", "assets": [{"asset_id": "a", "path": "p", "sheet": "S"}, {"asset_id": "a", "path": "q"}]}))
    assets, problems = messages.manifest(spark, str(tmp_path / "m.json"))
    assert assets.count() == 2 and sorted(r["code"] for r in problems.collect()) == ["manifest.duplicate", "manifest.field"]
    (tmp_path / "d.json").write_text('{"id": "x", "language": "ja", "hotwords": ["w"]}\n{broken\n{"id": "y"}\n')
    seeds = spark.createDataFrame([("x", "zh", []), ("z", "zh", ["v"])], "id string, language string, hotwords array<string>")
    got = {r["id"]: r["language"] for r in messages.dictionary(spark, str(tmp_path / "d.json"), seeds).collect()}
    assert got == {"x": "ja", "z": "zh"}


def test_store_keeps_one_row_per_id(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), {"sessions": SESSIONS, "segments": SEGMENTS})
    row = lambda i, text, status="Final", session=1: (session, None, i, text, None, status, 0, 1)
    batch = lambda *rows: spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], f"{SEGMENTS}, ord long")
    store.create_sessions(spark.createDataFrame([(1, "Running", 0, "ja"), (2, "Running", 0, "ja")], SESSIONS))
    write = store.sink("ord")
    for _ in range(2):  # a batch that comes again changes nothing
        write(batch(row("a", "one"), row("b", "two"), row("c", "part", "Partial")), 0)
    write(batch(row("a", "ONE"), row("d", "three"), row("e", "other", session=2)), 1)
    got = {r["id"]: (r["seq"], r["text"]) for r in store.read("segments").where("session = 1").collect()}
    assert got == {"a": (1, "ONE"), "b": (2, "two"), "d": (3, "three")}
    store.delete(spark.createDataFrame([(1,)], "session long"))
    assert [r["id"] for r in store.read("segments").collect()] == ["e"] and [r["session"] for r in store.read("sessions").collect()] == [2]


EVENTS = "session long, ms long, text string, silence_ms long, flush boolean, loud boolean"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = []
    for s in (1, 2):
        for i in range(12):
            rows.append((s, 1000 * i + s, "the quick brown fox jumps"[: 4 + 2 * i], 800 if i % 6 == 5 else 0, i == 11, True))
    want = sorted(map(tuple, captions_batch(spark.createDataFrame(rows, EVENTS)).collect()))
    assert len(want) >= 2
    for n, lo in enumerate(range(0, 24, 6)):  # each session's events stay in order
        part = [r for r in sorted(rows, key=lambda r: r[1])][lo : lo + 6]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    got = []
    query = captions_stream(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(got) == want


def test_due_and_recovered_jobs(spark):
    rows = spark.createDataFrame([("a", "InProgress", None), ("b", "Pending", 5), ("c", "RetryScheduled", 50), ("d", "Succeeded", 1)], "job string, state string, next_at long")
    assert {r["job"]: r["state"] for r in jobs.recover(rows).collect()}["a"] == "Pending"
    assert sorted(r["job"] for r in jobs.due(rows, 10).collect()) == ["b"]


def test_split_parts(spark):
    cases = {"short": ["short"], "one two three four": ["one two", "three", "four"], "a" * 25: ["a" * 10, "a" * 10, "a" * 5], "line one\nline two and more": ["line one", "line two", "and", "more"], "  lead " + "b" * 12: ["  lead", "b" * 10, "bb"], " " * 12: [], "ab\n\n\ncd efghijklm": ["ab", "cd", "efghijklm"]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r["t"]: r["parts"] for r in rows.select("t", render.split_parts(F.col("t"), 10).alias("parts")).collect()}
    assert got == cases
    assert render.chunk_texts(spark.createDataFrame([(1, None)], "i int, t string"), "i", "t").count() == 0
