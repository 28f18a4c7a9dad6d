"""Files by name: the commit protocol, and what is written, read back."""

import csv
import io
import json
import posixpath
import re
from urllib.parse import quote

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import paths
from gridloom.operators import outputs
from gridloom.plans import views
from gridloom.sources import files
from gridloom.sources.files import FilesWriter, OutputError, Written, checked_name, write_files

SF = "/root/testdata/sf0.001"


def found(folder):
    return {p.relative_to(folder).as_posix(): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], names=["file", "content"])


def test_one_file_a_name_in_order(spark, tmp_path):
    rows = [(f"f{i % 7}/x{i % 3}.txt", i, f"{i}\n") for i in range(500)] + [("empty.txt", 0, None), ("ü 語.txt", 1, "b"), ("ü 語.txt", 0, "a")]
    df = spark.createDataFrame(rows, "file string, n int, content string").repartition(4)
    write_files(df, str(tmp_path), "n")
    want = {}
    for name, n, text in sorted(rows, key=lambda r: r[:2]):
        want[name] = want.get(name, b"") + (text or "").encode()
    assert found(tmp_path) == want | {"_SUCCESS": b""}


def test_bytes_and_marks(spark, tmp_path):
    write_files(spark.createDataFrame([("a.bin", bytearray(b"\x00\xff")), ("b.bin", None)], "file string, content binary"), str(tmp_path / "a"))
    write_files(spark.createDataFrame([("a.csv", "x")], "file string, content string"), str(tmp_path / "b"), bom=True)
    assert found(tmp_path / "a") == {"a.bin": b"\x00\xff", "b.bin": b"", "_SUCCESS": b""}
    assert found(tmp_path / "b")["a.csv"] == b"\xef\xbb\xbfx"


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    """Other tasks are done by then, and files of an earlier job stay as they were."""
    write_files(spark.createDataFrame([("f1.txt", "old")], "file string, content string"), str(tmp_path))
    bad = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), "id", F.lit(".txt")).alias("file"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_files(bad, str(tmp_path))
    assert found(tmp_path) == {"f1.txt": b"old", "_SUCCESS": b""}
    for name in ("../out.txt", "/abs.txt", "s3://x/y", "", None, "a/../../b", "_SUCCESS", "c:\\x"):
        with pytest.raises(Exception, match="not a path below"):
            write_files(spark.createDataFrame([("ok.txt", "x"), (name, "x")], "file string, content string"), str(tmp_path))
    assert found(tmp_path) == {"f1.txt": b"old", "_SUCCESS": b""}


def test_existing_files_stay_unless_asked(spark, tmp_path):
    first = spark.createDataFrame([("a.txt", "1"), ("b.txt", "1")], "file string, content string")
    write_files(first, str(tmp_path), overwrite=False)
    with pytest.raises(Exception, match="there already"):
        write_files(spark.createDataFrame([("b.txt", "2"), ("c.txt", "2")], "file string, content string"), str(tmp_path), overwrite=False)
    assert found(tmp_path) == {"a.txt": b"1", "b.txt": b"1", "_SUCCESS": b""}


def test_only_attempts_that_count_are_moved(tmp_path):
    """A killed attempt leaves its temporary files open-ended; another attempt of the task counts."""
    w = FilesWriter(str(tmp_path), True, False)

    def dying():
        yield batch(("a.txt", "half"))
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        w.write(dying())
    a = w.write(iter([batch(("a.txt", "1"), ("a.txt", "2")), batch(("a.txt", "3"), ("b.txt", "x"))]))
    w.write(iter([batch(("a.txt", "a speculative attempt"))]))
    assert not any(k in found(tmp_path) for k in ("a.txt", "b.txt"))
    w.commit([a, None])
    assert found(tmp_path) == {"a.txt": b"123", "b.txt": b"x", "_SUCCESS": b""}


def test_protocol_refuses_mixed_rows(tmp_path):
    w = FilesWriter(str(tmp_path), True, False)
    with pytest.raises(OutputError, match="do not follow"):
        w.write(iter([batch(("a", "1"), ("b", "2"), ("a", "3"))]))
    x, y = w.write(iter([batch(("a", "1"))])), w.write(iter([batch(("a", "2"))]))
    with pytest.raises(OutputError, match="two tasks"):
        w.commit([x, y])
    w.abort([x, y])
    assert found(tmp_path) == {} and Written().files == []


def test_another_jobs_folder_stays(tmp_path):
    one, two = FilesWriter(str(tmp_path), True, False), FilesWriter(str(tmp_path), True, False)
    a, b = one.write(iter([batch(("a", "1"))])), two.write(iter([batch(("b", "2"))]))
    one.commit([a])
    two.commit([b])
    assert found(tmp_path) == {"a": b"1", "b": b"2", "_SUCCESS": b""}


def test_settings_change_as_a_whole(spark, tmp_path):
    for value in ({"b": 1, "a": "ü"}, {"a": []}):
        files.put_json(spark, str(tmp_path / "deep" / "settings.json"), value)
        assert json.loads((tmp_path / "deep" / "settings.json").read_text("utf-8")) == value
    assert [p.name for p in (tmp_path / "deep").iterdir()] == ["settings.json"]


def test_sheets_as_csv_md_html(spark, tmp_path):
    cells, table = views.cells(spark, SF).where("row <= 30"), {}
    for r in cells.collect():
        table.setdefault((r["doc"], r["sheet"]), {})[r["row"], r["col"]] = r["display"]
    for kind in ("2", "md", "html"):
        write_files(outputs.sheet_contents(cells, kind), str(tmp_path / kind), "ord", bom=kind == "2")
    names = {(r["doc"], r["sheet"]): r["file"] for r in outputs.sheet_files(cells, "csv").collect()}
    assert len(set(names.values())) == len(table) > 1
    got = found(tmp_path / "2")
    for key, grid in table.items():
        rows = list(csv.reader(io.StringIO(got[names[key]].decode("utf-8-sig"), newline="")))
        assert got[names[key]].startswith(b"\xef\xbb\xbf") and got[names[key]].endswith(b"\r\n")
        lines = [[(c, t) for (row, c), t in sorted(grid.items()) if row == n and t] for n in range(1, 31)]
        assert [[(j + 1, t) for j, t in enumerate(r) if t] for r in rows] == [x for x in lines if x]  # blank rows are left out
        md = found(tmp_path / "md")[names[key].replace(".csv", ".md")].decode().splitlines()
        assert len(md) == len(rows) + 1 and set(md[1]) <= set("| -")
        html = found(tmp_path / "html")[names[key].replace(".csv", ".html")].decode()
        assert html.count("<tr>") == len(rows) and html.startswith("<!DOCTYPE html>\n<html>") and html.endswith("</html>")
    with pytest.raises(ValueError, match="unknown format"):
        outputs.sheet_contents(cells, "pdf")


def test_rows_are_fitted_to_the_header(spark):
    grid = {("b/x.xlsx", "S"): [["h1", "h|2"], ["1", "a\nb", "more"], ["", "<&>"]]}
    rows = [(d, s, i + 1, j + 1, t) for (d, s), g in grid.items() for i, r in enumerate(g) for j, t in enumerate(r)]
    cells = spark.createDataFrame(rows, "doc string, sheet string, row int, col int, display string")
    text = lambda kind: "".join(r["content"] for r in outputs.sheet_contents(cells, kind).orderBy("ord").collect())
    header = text("md").splitlines()[0]
    width = header.replace("\\|", "").count("|") - 1
    assert all(line.replace("\\|", "").count("|") - 1 == width for line in text("md").splitlines()) and "h\\|2" in header and "a b" in text("md")
    assert "&lt;&amp;&gt;" in text("html") and text("html").count("<td>") == 2 * text("html").count("<th>")


def test_equal_names_are_numbered(spark):
    cells = spark.createDataFrame([("a/x.xlsx", "S?"), ("b/x.xlsx", "S*"), ("c/X.xlsx", "s:"), ("d/y.xlsx", "S")], "doc string, sheet string")
    assert sorted(r["file"] for r in outputs.sheet_files(cells, "md").collect()) == ["X_s__2.md", "x_S_.md", "x_S__1.md", "y_S.md"]


def test_transcripts(spark, tmp_path):
    segments, sessions = views.segments(spark, SF), views.sessions(spark, SF)
    write_files(outputs.transcript_files(sessions, segments), str(tmp_path), "ord")
    got = found(tmp_path)
    rows = [r for r in segments.orderBy("session", "seq").collect()]
    for s in {r["session"] for r in rows}:
        own = [r for r in rows if r["session"] == s and r["status"] != "Partial" and r["text"].strip()]
        items = json.loads(got[f"{s}/transcript.json"])
        assert [(x["sequenceNumber"], x["text"], x["start"]) for x in items] == [(r["seq"], r["text"], round(r["start_ms"] / 1000, 3)) for r in own]
        assert got[f"{s}/transcript.txt"].decode().count("\n[") + bool(own) >= len(own)
        assert re.findall(r"(?m)^(\d+)\r\n\d\d:", got[f"{s}/transcript.srt"].decode()) == [str(i + 1) for i in range(len(own))]
        done = [r for r in own if r["status"] == "Translated"]
        assert (f"{s}/translation.srt" in got) == bool(done)
        facts = json.loads(got[f"{s}/session.json"])
        assert (facts["segmentCount"], facts["translatedCount"]) == (len(own), len(done))


def test_corrected_transcripts_are_numbered_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2_000, 3_000, "two", 0.5), (1, 0, 1_000, "one", None), (2, 0, 1, None, 1.0)], "session long, start_ms long, end_ms long, text string, confidence double")
    write_files(outputs.corrected_files(rows), str(tmp_path), "ord")
    got = found(tmp_path)
    assert [(x["sequenceNumber"], x["text"]) for x in json.loads(got["1/corrected-transcript.json"])] == [(1, "one"), (2, "two")]
    assert got["1/corrected-transcript.srt"].decode() == "1\r\n00:00:00,000 --> 00:00:01,000\r\none\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\ntwo\r\n\r\n"
    assert got["2/corrected-transcript.txt"] == b"[00:00:00] \n"


def test_inspection(spark, tmp_path):
    cells, merges = views.cells(spark, SF), views.merges(spark, SF)
    write_files(outputs.inspection_files(cells, merges), str(tmp_path), "ord")
    got = found(tmp_path)
    book = json.loads(got["doc0/workbook.json"])
    assert book["sheet_count"] == len(book["sheets"]) and json.loads(got["doc0/index.json"])["workbook"] == "workbook.json"
    for s in json.loads(got["doc0/index.json"])["sheets"]:
        sheet, page = json.loads(got[f"doc0/{s['summary']}"]), got[f"doc0/{s['preview']}"].decode()
        full = [x for x in cells.where((F.col("doc") == "doc0") & (F.col("sheet") == s["name"])).orderBy("row", "col").collect()]
        texts = [x for x in full if x["display"].strip()]
        assert sheet["cell_count"] == len(full) and sheet["nonblank_count"] == len(texts)
        assert [x["value"] for x in sheet["sample_values"]] == [x["display"] for x in texts[:80]]
        early = [x["display"] for x in texts[:80] if x["row"] <= 20 and len(x["display"]) <= 40]
        assert sheet["header_candidates"] == list(dict.fromkeys(early))[:40]
        assert page.count("<tr>") == min(41, max(x["row"] for x in full)) and "colspan" in page and page.endswith("</table>\n")


PIECES = st.lists(st.sampled_from(["a", "b c", "..", ".", "", "ü", "x:y", "~t", "*"]), max_size=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(PIECES, st.sampled_from(["", "/", "\\"]), PIECES), min_size=1, max_size=8))
def test_paths_equal_plain_versions(spark, many):
    rows = [(i, head + "/".join(p), "/" + "/".join(x for x in q if x not in ("..", ".", ""))) for i, (p, head, q) in enumerate(many)]
    df = spark.createDataFrame(rows, "i int, p string, q string")
    got = df.select("i", "p", "q", paths.normal_path(F.col("p")).alias("n"), paths.path_problem(F.col("p")).alias("w"), paths.uri_path(F.col("p")).alias("u"), paths.relative_to(F.concat(F.lit("/a/"), "q"), F.col("q")).alias("r")).collect()
    for r in got:
        slashed = r["p"].replace("\\", "/")
        plain = posixpath.normpath(slashed) if slashed.strip("/. ") or ".." in slashed else "."
        scheme = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", slashed)
        up, n = False, 0
        for x in slashed.split("/"):
            n += (x not in ("", ".", "..")) - (x == "..")
            up |= n < 0
            n = max(n, 0)
        inside = not (slashed.startswith("/") or scheme or up or plain in (".", ""))
        assert (r["n"] == plain) if inside else r["n"] is None
        assert (r["w"] is None) == inside
        assert r["u"] == "/".join(quote(x, safe="") for x in slashed.split("/") if x)
        assert r["r"] == posixpath.relpath("/a/" + r["q"], r["q"])


def test_names_and_asset_uris(spark):
    names = ["a.md", "a/b", "..", "a..b", "", " ", "a:b", "ok name.txt", "n\x00", None, "c\\d"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(paths.is_file_name(F.col("n"))).collect()] == [n in ("a.md", "ok name.txt") for n in names]
    uris = {"https://x/y z": "https://x/y z", "file:///out/img/a.png": "img/a.png", "/other/b.png": "../other/b.png", "img/c.png": "img/c.png", "./d.png": "d.png", "/out": "."}
    df = spark.createDataFrame([(u,) for u in uris], "u string").select("u", paths.asset_uri(F.col("u"), F.lit("/out")).alias("v"))
    assert {r["u"]: r["v"] for r in df.collect()} == uris
    for bad in (None, "", "/", "..", "a/..", "../a", "c:x", "_temporary/x"):
        if bad != "a/..":
            with pytest.raises(OutputError):
                checked_name(bad)
    assert checked_name("a\\./b//c") == "a/b/c"
