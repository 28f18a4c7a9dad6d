"""Registered queries over whole documents and around meetings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import documents, grid, meeting, render
from gridloom.plans.registry import query

# Meetings.


@query("preflight_rollup", """SELECT event_id AS id, CAST(event_id % 7 = 0 AS BIGINT) + CAST(event_id % 11 = 0 AS BIGINT) AS errors,
 CAST(event_id % 3 = 0 AS BIGINT) + CAST(event_id % 5 = 0 AS BIGINT) + CAST(event_id % 2 = 0 AND event_id % 13 = 0 AS BIGINT) AS warnings, event_id % 7 <> 0 AND event_id % 11 <> 0 AS ready,
 event_id % 3 <> 0 AND event_id % 5 <> 0 AS recording, event_id % 2 = 0 AND event_id % 13 <> 0 AS translation FROM events""")
def _(view, table):
    i, yes = F.col("event_id"), F.lit(True)
    checks = dict.fromkeys((*meeting.BLOCKING, *meeting.RECORDING, *meeting.TRANSLATION), yes) | {"model": i % 7 != 0, "disk": i % 11 != 0, "encoder": i % 3 != 0, "media_tools": i % 5 != 0, "translation_key": i % 13 != 0, "translate": i % 2 == 0}
    return meeting.preflight(table("events").select(i.alias("id"), *[c.alias(n) for n, c in checks.items()]))


@query("log_retention", """SELECT o_orderkey AS id, 'app-' || strftime(o_orderdate, '%Y%m%d') || '.log' AS name FROM orders WHERE o_orderkey % 9 <> 0 AND CAST(o_orderdate AS DATE) < DATE '1996-01-01' - 30""")
def _(view, table):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("note-"), day, F.lit(".txt"))).otherwise(F.concat(F.lit("app-"), day, F.lit(".log")))
    return meeting.expired_logs(table("orders").select(F.col("o_orderkey").alias("id"), name.alias("name")), F.lit("1996-01-01").cast("date"), 30)


@query("loud_windows", """, w AS (SELECT session, stream, frame // 4 AS w, sqrt(avg((sample / 32768.0::DOUBLE) * (sample / 32768.0::DOUBLE))) AS rms FROM v_frames GROUP BY ALL) SELECT session, stream, bool_or(rms >= 0.9) AS loud FROM w GROUP BY ALL""")
def _(view, table):
    return meeting.loud(view("frames"), ["session", "stream"], "frame", F.col("sample") / 32768.0, 4, 0.9)


PROFILES = "p AS (SELECT c_custkey AS id, c_name AS name, ['ja', 'zh', 'en'][CAST(c_nationkey % 3 + 1 AS INTEGER)] AS language, c_custkey % 10 = 0 AS builtin FROM customer)"


def profiles(table):
    c = table("customer")
    language = F.element_at(F.array(*map(F.lit, ("ja", "zh", "en"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), language.alias("language"), (F.col("c_custkey") % 10 == 0).alias("builtin"))


@query("profiles_of_language", f"WITH {PROFILES} SELECT *, row_number() OVER (ORDER BY builtin DESC, lower(name), id) AS place FROM p WHERE language = 'ja'")
def _(view, table):
    return meeting.profiles_of(profiles(table), F.lit("ja"))


@query("active_profile", f"""WITH {PROFILES}, c AS (SELECT p_partkey AS k, ['ja', 'zh', 'en', 'fr'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS language, p_partkey % 200 + 1 AS active FROM part),
 b AS (SELECT language, min(id) AS own FROM p WHERE builtin GROUP BY language) SELECT c.language, CASE WHEN p.id IS NOT NULL THEN c.active ELSE b.own END AS id, count(*) AS n FROM c LEFT JOIN p ON p.id = c.active LEFT JOIN b ON b.language = c.language GROUP BY ALL""")
def _(view, table):
    language = F.element_at(F.array(*map(F.lit, ("ja", "zh", "en", "fr"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    chosen = table("part").select(language.alias("language"), (F.col("p_partkey") % 200 + 1).alias("active"))
    return meeting.active_profile(profiles(table), chosen).groupBy("language", "id").agg(F.count("*").alias("n"))


@query("first_existing_path", """WITH f AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_size < 3), c AS (SELECT p_partkey AS id, i AS ord, CASE i WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE 'Brand#11' END AS path FROM part, range(3) AS u(i)),
 x AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM c JOIN f USING (path)) SELECT p_partkey AS id, x.path FROM part LEFT JOIN x ON x.id = p_partkey AND n = 1""")
def _(view, table):
    parts = table("part")
    options = F.array("p_type", "p_brand", F.lit("Brand#11"))
    candidates = parts.select(F.col("p_partkey").alias("id"), F.posexplode(options).alias("ord", "path"))
    return meeting.first_existing(candidates, parts.where("p_size < 3").select(F.col("p_brand").alias("path")))


@query("complete_models", """WITH s AS (SELECT o_custkey AS path, max(CAST(o_totalprice * 10000 AS BIGINT)) AS size FROM orders GROUP BY ALL) SELECT CAST(c_nationkey AS BIGINT) AS model, bool_and(coalesce(s.size >= 1000000, false)) AS complete FROM customer LEFT JOIN s ON s.path = c_custkey WHERE c_custkey % 3 <> 0 GROUP BY c_nationkey""")
def _(view, table):
    files = table("orders").select(F.col("o_custkey").alias("path"), (F.col("o_totalprice") * 10_000).cast("long").alias("size"))
    needed = table("customer").where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("model"), F.col("c_custkey").alias("path"), F.lit(1_000_000).alias("least"))
    return meeting.complete(needed, files)


@query("visible_titles", """SELECT p_type AS title, min_by(p_partkey, p_partkey) AS handle FROM part WHERE lower(p_type) NOT IN (SELECT lower(min(p_type)) FROM part) GROUP BY p_type""")
def _(view, table):
    parts = table("part")
    first = parts.agg(F.min("p_type")).first()[0]
    return meeting.visible_titles(parts.select(F.col("p_type").alias("title"), F.col("p_partkey").alias("handle"), F.col("p_partkey").alias("ord")), [first.upper()])


@query("caption_metrics", """, c AS (SELECT session, ['partial', 'final', 'empty', 'skipped', 'discarded'][CAST(id % 5 + 1 AS INTEGER)] AS kind, id % 900 AS audio_ms, id % 170 AS busy_ms FROM v_samples), g AS (SELECT session, count(*) FILTER (kind = 'partial') AS partials, count(*) FILTER (kind = 'final') AS finals, count(*) FILTER (kind = 'empty') AS emptys, count(*) FILTER (kind = 'skipped') AS skippeds,
 CAST(coalesce(sum(audio_ms) FILTER (kind = 'final'), 0) AS BIGINT) AS final_ms, CAST(coalesce(sum(audio_ms) FILTER (kind = 'discarded'), 0) AS BIGINT) AS discarded_ms, CAST(coalesce(sum(audio_ms) FILTER (kind IN ('partial', 'final', 'empty')), 0) AS DOUBLE) AS heard, sum(busy_ms) AS busy FROM c GROUP BY session)
 SELECT session, partials, finals, emptys, skippeds, final_ms, discarded_ms, CASE WHEN heard > 0 THEN busy / heard END AS rtf FROM g""")
def _(view, table):
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("partial", "final", "empty", "skipped", "discarded"))), (i % 5 + 1).cast("int"))
    return meeting.caption_metrics(view("samples").select("session", kind.alias("kind"), (i % 900).alias("audio_ms"), (i % 170).alias("busy_ms")))


@query("recovery_counts", """SELECT count(*) FILTER (state = 'Running') AS recovered, count(*) FILTER (state = 'Completed') AS completed, count(*) FILTER (state = 'StoppedDiskFull') AS stopped, count(*) AS sessions FROM v_sessions""")
def _(view, table):
    return meeting.recovery_counts(view("sessions"))


@query("jobs_by_session", """SELECT split_part(segment, '-', 1) AS session, job, row_number() OVER (PARTITION BY split_part(segment, '-', 1) ORDER BY ord) AS place FROM v_jobs""")
def _(view, table):
    from gridloom.operators.jobs import jobs_of_sessions

    return jobs_of_sessions(view("jobs").withColumn("session", F.substring_index("segment", "-", 1))).select("session", "job", "place")


@query("media_probe", """SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS duration, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS start, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) / (o_orderkey % 5) END AS frame_rate, o_orderkey % 3 = 0 AS has_audio FROM orders""")
def _(view, table):
    k = F.col("o_orderkey")
    video = F.named_struct(F.lit("codec_type"), F.when(k % 4 != 0, "video").otherwise("data"), F.lit("r_frame_rate"), F.concat_ws("/", F.col("o_custkey").cast("string"), (k % 5).cast("string")), F.lit("start_time"), F.col("o_custkey").cast("string"))
    sound = F.named_struct(F.lit("codec_type"), F.when(k % 3 == 0, "audio").otherwise("subtitle"), F.lit("r_frame_rate"), F.lit("0/0"), F.lit("start_time"), F.lit("N/A"))
    shape = F.struct(F.struct(F.col("o_totalprice").cast("string").alias("duration")).alias("format"), F.array(sound, video).alias("streams"))
    return meeting.media_probe(table("orders").select(k.alias("id"), F.to_json(shape).alias("json"))).drop("json")


@query("unit_math", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey * 1000000 / 1073741824.0::DOUBLE AS gb, CASE WHEN l_suppkey % 7 > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * l_partkey / (l_suppkey % 7 * 8))) END AS cpu FROM lineitem""")
def _(view, table):
    wall = F.col("l_suppkey") % 7
    return table("lineitem").select("l_orderkey", "l_linenumber", meeting.gigabytes(F.col("l_partkey") * 1_000_000).alias("gb"), meeting.cpu_percent(F.col("l_partkey"), wall, 8).alias("cpu"))


@query("language_names", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Japanese' WHEN 1 THEN 'Simplified Chinese' WHEN 2 THEN 'English' WHEN 3 THEN 'fr' ELSE 'the source language' END AS name, CASE c_nationkey % 5 WHEN 2 THEN 'Not specified' WHEN 0 THEN '未明确' ELSE '未明确' END AS missing FROM customer""")
def _(view, table):
    code = F.element_at(F.array(F.lit("JA"), F.lit("zh"), F.lit("en"), F.lit("fr"), F.lit(None).cast("string")), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return table("customer").select("c_custkey", meeting.language_name(code).alias("name"), meeting.not_specified(code).alias("missing"))


@query("option_errors", """SELECT l_orderkey * 10 + l_linenumber AS id, 'interval' AS option, 'interval must be from 5 to 30' AS message FROM lineitem WHERE l_quantity < 5 OR l_quantity > 30 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'share', 'share must be from 0 to 0.05' FROM lineitem WHERE l_discount > 0.05""")
def _(view, table):
    rows = table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("interval"), F.col("l_discount").cast("double").alias("share"))
    return meeting.option_errors(rows, {"interval": (5, 30), "share": (0, 0.05)})


@query("summary_parts", """, r AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY seq) - 1) // 3 AS g, seq, CASE WHEN trim(text) = '' THEN '[]' ELSE to_json([left(text, 4000)]) END AS p FROM v_segments)
 SELECT session, g AS "group", '[' || string_agg('{"points":' || p || '}', ',' ORDER BY seq) || ']' AS json FROM r GROUP BY session, g""")
def _(view, table):
    return meeting.summary_parts(view("segments").select("session", F.col("seq").alias("ord"), F.array("text", F.lit(None).cast("string"), F.lit(" ")).alias("points")), 3)


@query("summary_markdown", """, x AS (SELECT session, seq, trim(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '|', '\\|')) AS t FROM v_segments WHERE trim(text) <> ''), s AS (SELECT session, count(*) AS n FROM v_segments GROUP BY session),
 b AS (SELECT session, string_agg('- ' || t, chr(10) ORDER BY seq) AS o FROM x WHERE seq % 2 = 0 GROUP BY session), a AS (SELECT session, string_agg('| ' || t || ' | ' || CASE WHEN seq % 4 = 1 THEN 'me' ELSE 'Not specified' END || ' | Not specified |', chr(10) ORDER BY seq) AS o FROM x WHERE seq % 2 = 1 GROUP BY session)
 SELECT session, '# Meeting Summary' || chr(10) || chr(10) || '- Meeting type：Group discussion' || chr(10) || '- Summary language：English' || chr(10) || '- Segment count：' || n || chr(10) || '- Source: confirmed original captions' || chr(10) || chr(10)
 || '## Meeting overview' || chr(10) || chr(10) || coalesce(b.o, 'No relevant content extracted.') || chr(10) || chr(10) || array_to_string([ '## ' || h || chr(10) || chr(10) || 'No relevant content extracted.' || chr(10) || chr(10) for h in ['Discussion topics', 'Key opinions', 'Decisions']], '')
 || '## Action items' || chr(10) || chr(10) || coalesce('| Task | Owner | Due |' || chr(10) || '|---|---|---|' || chr(10) || a.o, 'No relevant content extracted.') || chr(10) || chr(10) || array_to_string([ '## ' || h || chr(10) || chr(10) || 'No relevant content extracted.' || chr(10) || chr(10) for h in ['Unresolved questions', 'Risks and notes']], '') AS content
 FROM s LEFT JOIN b USING (session) LEFT JOIN a USING (session)""")
def _(view, table):
    seq = F.col("seq")
    rows = view("segments")
    items = rows.select("session", F.when(seq % 2 == 0, "overview").otherwise("action_items").alias("section"), seq.alias("ord"), F.trim("text").alias("text"), F.when(seq % 4 == 1, "me").alias("owner"), F.lit(" ").alias("due"))
    docs = rows.groupBy("session").agg(F.count("*").alias("segments")).withColumns({"language": F.lit("en"), "layout": F.lit("group")})
    return meeting.summary_markdown(items, docs)


# Documents.


@query("document_type", """, n AS (SELECT doc, string_agg(DISTINCT sheet, ' ' ORDER BY sheet) AS s FROM v_cells GROUP BY doc) SELECT doc, CASE WHEN CAST(substr(doc, 4) AS BIGINT) % 3 = 1 THEN 'wanted' WHEN CAST(substr(doc, 4) AS BIGINT) % 2 = 0 THEN 'report-design' ELSE 'generic' END AS kind FROM n""")
def _(view, table):
    number = F.substring("doc", F.lit(4), F.length("doc")).cast("long")
    names = view("cells").groupBy("doc").agg(F.array_sort(F.collect_set("sheet")).alias("names"))
    more = F.when(number % 2 == 0, F.concat("names", F.array(F.lit("帳票一覧")))).otherwise(F.col("names"))
    return names.select("doc", documents.document_type(more, F.when(number % 3 == 1, "wanted").otherwise("")).alias("kind"))


@query("semantic_columns", """SELECT DISTINCT doc, sheet, CAST(col AS BIGINT) AS col FROM v_cells WHERE sheet = 'BUILDING' OR col IN (2, 4)""")
def _(view, table):
    cells = view("cells")
    return documents.semantic_columns(cells, cells.where("sheet <> 'BUILDING' and col in (2, 4)"))


@query("collapse_masters", """SELECT c.doc, c.sheet, c."row", CAST(c.col AS BIGINT) AS col FROM v_cells c LEFT JOIN v_merges m ON m.doc = c.doc AND m.sheet = c.sheet AND c."row" BETWEEN m.r0 AND m.r1 AND c.col BETWEEN m.c0 AND m.c1 WHERE NOT (m.r0 IS NOT NULL AND c.col > m.c0)""")
def _(view, table):
    members = view("cells").select("doc", "sheet", "row", "col").join(grid.merge_members(view("merges")), ["doc", "sheet", "row", "col"], "left")
    return documents.collapse_masters(members).select("doc", "sheet", "row", "col")


ASSETS_SQL = """, a AS (SELECT doc, CASE WHEN "row" % 3 = 0 THEN NULL ELSE sheet END AS sheet, 'a' || ("row" % 40) AS asset, CASE WHEN "row" % 2 = 0 THEN 'image' ELSE 'chart' END AS kind, sheet || '/' || "row" AS uri, CASE WHEN "row" % 5 <> 0 THEN "row" END AS r FROM v_grid WHERE "row" <= 40 AND ("row" % 3 <> 0 OR sheet = 'BUILDING')),
 s AS (SELECT DISTINCT doc, sheet FROM v_grid), e AS (SELECT doc, sheet, asset, kind, uri, r, 0 AS k FROM a WHERE sheet IS NOT NULL UNION ALL SELECT s.doc, s.sheet, asset, kind, uri, r, 1 FROM a JOIN s ON s.doc = a.doc WHERE a.sheet IS NULL),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, sheet, asset ORDER BY k) AS n FROM e) WHERE n = 1)"""


def _assets(view):
    rows = view("cells").where("col = 1 and row <= 40 and (row % 3 <> 0 or sheet = 'BUILDING')")
    return rows.select("doc", F.when(F.col("row") % 3 != 0, F.col("sheet")).alias("sheet"), F.concat(F.lit("a"), (F.col("row") % 40).cast("string")).alias("asset"), F.when(F.col("row") % 2 == 0, "image").otherwise("chart").alias("kind"), F.concat_ws("/", "sheet", F.col("row").cast("string")).alias("uri"), F.when(F.col("row") % 5 != 0, F.col("row")).alias("row"))


@query("effective_assets", ASSETS_SQL + """ SELECT doc, sheet, asset, kind, uri, r AS "row", row_number() OVER (PARTITION BY doc, sheet, kind ORDER BY r NULLS LAST, asset) AS number FROM f""")
def _(view, table):
    return documents.numbered_assets(documents.effective_assets(_assets(view), view("cells").select("doc", "sheet").distinct()))


@query("bind_assets", """, b AS (SELECT doc, 'a' || "row" AS asset, CASE WHEN "row" % 4 = 0 THEN 'gone' ELSE sheet END AS sheet, CASE WHEN "row" % 2 = 0 THEN 'r' || ("row" % 6) END AS region FROM v_grid WHERE "row" <= 60)
 SELECT doc, asset, CASE WHEN sheet = 'gone' THEN 'asset.sheet_missing' WHEN region IS NOT NULL AND region <> 'r2' THEN 'asset.region_missing' END AS code, count(*) AS n FROM b WHERE sheet = 'gone' OR region <> 'r2' GROUP BY ALL
 UNION ALL SELECT doc, asset, 'new', count(*) FROM b WHERE CAST(substr(asset, 2) AS BIGINT) > 30 GROUP BY ALL""")
def _(view, table):
    rows = view("cells").where("col = 1 and row <= 60")
    row, asset = F.col("row"), F.concat(F.lit("a"), F.col("row").cast("string"))
    bindings = rows.select("doc", asset.alias("asset"), F.when(row % 4 == 0, "gone").otherwise(F.col("sheet")).alias("sheet"), F.when(row % 2 == 0, F.concat(F.lit("r"), (row % 6).cast("string"))).alias("region"))
    sheets = rows.select("doc", "sheet").distinct()
    new, missing = documents.bind_assets(bindings, rows.where("row <= 30").select("doc", asset.alias("asset")), sheets, sheets.withColumn("region", F.lit("r2")))
    found = missing.unionByName(new.select("doc", "asset", F.lit("new").alias("code")))
    return found.groupBy("doc", "asset", "code").agg(F.count("*").alias("n"))


@query("readable_values", """SELECT doc, sheet, 'r' || ("row" % 3) AS region, "row" AS ord, CASE col WHEN 1 THEN 'Name' ELSE 'k' || col END AS label, display AS value FROM v_cells WHERE display <> ''""")
def _(view, table):
    values = view("cells").select("doc", "sheet", F.concat(F.lit("r"), (F.col("row") % 3).cast("string")).alias("region"), F.col("row").alias("ord"), F.concat(F.lit("k"), F.col("col").cast("string")).alias("key"), F.col("display").alias("value"))
    labels = values.where("key = 'k1'").select("doc", "sheet", "region", "key").distinct().withColumn("label", F.lit("Name"))
    return documents.readable_values(values, labels)


@query("renderable_regions", """, g AS (SELECT DISTINCT doc, sheet, CASE WHEN "row" % 10 = 0 THEN 'unrecognized-' ELSE 'r' END || "row" AS region, "row" FROM v_grid) SELECT doc, sheet, region FROM g WHERE "row" % 10 <> 0 AND ("row" % 4 = 0 OR EXISTS (SELECT 1 FROM v_cells c WHERE c.doc = g.doc AND c.sheet = g.sheet AND c."row" = g."row" AND c.col >= 4 AND trim(display) <> ''))""")
def _(view, table):
    cells = view("cells").withColumn("region", F.concat(F.when(F.col("row") % 10 == 0, "unrecognized-").otherwise("r"), F.col("row").cast("string")))
    regions = cells.select("doc", "sheet", "region").distinct()
    assets = cells.where("row % 4 = 0").select("doc", "sheet", "region").distinct()
    values = cells.where("col = 4").select("doc", "sheet", "region", F.col("display").alias("value"))
    return documents.renderable(regions, values, cells.where("col = 6"), assets)


@query("screen_ids", """, m AS (SELECT doc, CASE WHEN sheet = 'BUILDING' THEN 0 ELSE 1 END AS rank, ['screen_id', '画面ID', 'other'][CAST("row" % 3 + 1 AS INTEGER)] AS key, CASE WHEN "row" % 5 = 0 THEN '' ELSE sheet || "row" END AS value, "row" FROM v_grid)
 SELECT doc, min_by(value, (rank, CASE key WHEN 'screen_id' THEN 1 ELSE 2 END, "row", value)) AS screen_id FROM m WHERE key <> 'other' AND value <> '' AND (rank = 0 OR value LIKE 'MACHINERY%') GROUP BY doc""")
def _(view, table):
    row = F.col("row")
    rows = view("cells").where("col = 1 and (sheet = 'BUILDING' or sheet = 'MACHINERY')")
    key = F.element_at(F.array(*map(F.lit, ("screen_id", "画面ID", "other"))), (row % 3 + 1).cast("int"))
    value = F.when(row % 5 == 0, "").otherwise(F.concat("sheet", row.cast("string")))
    return documents.screen_ids(rows.select("doc", F.when(F.col("sheet") == "BUILDING", 0).otherwise(1).alias("rank"), key.alias("key"), value.alias("value"), row.alias("ord")), ["screen_id", "画面ID"])


CHUNK_TEXT = "'title ' || doc"


@query("document_chunks", """, r AS (SELECT doc, sheet, 'r' || ("row" % 2) AS region, string_agg('k' || "row" || ': ' || display, chr(10) ORDER BY "row") AS lines FROM v_cells WHERE col = 1 AND display <> '' AND "row" <= 20 GROUP BY ALL), a AS (SELECT DISTINCT doc, sheet, 'r' || ("row" % 2) AS region FROM v_grid WHERE "row" <= 20), d AS (SELECT DISTINCT doc FROM v_grid)
 SELECT doc || ':document' AS chunk_id, 'document' AS kind, 'title ' || doc AS text, '{"document_id":"' || doc || '","document_title":"title ' || doc || '","template_id":"t","screen_id":"S' || substr(doc, 4) || '"}' AS metadata FROM d
 UNION ALL SELECT a.doc || ':' || a.sheet || ':' || a.region, 'section', a.region || coalesce(chr(10) || lines, ''), '{"document_id":"' || a.doc || '","document_title":"title ' || a.doc || '","template_id":"t","screen_id":"S' || substr(a.doc, 4) || '","sheet_id":"' || a.sheet || '","region_id":"' || a.region || '","region_type":"table"}' FROM a LEFT JOIN r USING (doc, sheet, region)""")
def _(view, table):
    cells = view("cells").where("col = 1 and row <= 20").withColumn("region", F.concat(F.lit("r"), (F.col("row") % 2).cast("string")))
    docs = view("cells").select("doc").distinct().select("doc", F.concat(F.lit("title "), "doc").alias("title"), F.lit("t").alias("template"), F.lit(None).cast("string").alias("version"))
    regions = cells.select("doc", "sheet", "region").distinct().withColumns({"kind": F.lit("table"), "ord": F.lit(1), "title": F.lit(None).cast("string")})
    values = cells.select("doc", "sheet", "region", F.col("row").alias("ord"), F.concat(F.lit("k"), F.col("row").cast("string")).alias("key"), F.col("display").alias("value"))
    ids = docs.select("doc", F.concat(F.lit("S"), F.substring("doc", F.lit(4), F.length("doc"))).alias("screen_id"))
    return documents.chunks(docs, regions, values, ids)


@query("canonical_json", """, c AS (SELECT doc, sheet, "row", string_agg('{"col":' || col || ',"text":' || to_json(display) || '}', ',' ORDER BY col) AS cells FROM v_cells GROUP BY ALL), r AS (SELECT doc, sheet, string_agg('{"cells":[' || cells || '],"row":' || "row" || '}', ',' ORDER BY "row") AS rows FROM c GROUP BY ALL)
 SELECT doc, '{"document_id":"' || doc || '","sheets":[' || string_agg('{"name":"' || sheet || '","rows":[' || rows || ']}', ',' ORDER BY sheet) || ']}' AS json FROM r GROUP BY doc""")
def _(view, table):
    return documents.canonical(view("cells"))


@query("canonical_rescan", 'SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, display FROM v_cells')
def _(view, table):
    return documents.from_canonical(documents.canonical(view("cells")).withColumn("json", F.concat(F.lit("﻿"), "json")))


COVER_SQL = """, k AS (SELECT *, "row" % 9 AS m FROM v_grid), c AS (SELECT doc, sheet, "row", 1 AS col, CASE m WHEN 1 THEN '基本設計' WHEN 2 THEN 'SCR-A' || "row" WHEN 3 THEN '画面設計書' WHEN 4 THEN repeat(c_name, 3) WHEN 5 THEN 'a_b' WHEN 6 THEN '作成者：' WHEN 7 THEN '文書番号' ELSE c_name END AS t FROM k UNION ALL SELECT doc, sheet, "row", 2, c_name FROM k WHERE m IN (6, 7))"""


def _cover(view, table):
    rows = view("cells").where("col = 1")
    named = table("customer").select(F.concat(F.lit("doc"), F.floor(F.col("c_custkey") / 500).cast("string")).alias("doc"), F.col("c_mktsegment").alias("sheet"), "c_custkey", "c_name")
    from pyspark.sql import Window

    named = named.withColumn("row", F.row_number().over(Window.partitionBy("doc", "sheet").orderBy("c_custkey")))
    rows = rows.select("doc", "sheet", "row").join(named, ["doc", "sheet", "row"])
    m, name = F.col("row") % 9, F.col("c_name")
    first = F.when(m == 1, "基本設計").when(m == 2, F.concat(F.lit("SCR-A"), F.col("row").cast("string"))).when(m == 3, "画面設計書").when(m == 4, F.repeat(name, F.lit(3))).when(m == 5, "a_b").when(m == 6, "作成者：").when(m == 7, "文書番号").otherwise(name)
    both = F.when(m.isin(6, 7), F.array(first, name)).otherwise(F.array(first))
    return rows.select("doc", "sheet", "row", F.posexplode(both).alias("i", "display")).select("doc", "sheet", "row", (F.col("i") + 1).alias("col"), "display")


@query("cover_sheets", COVER_SQL + """ SELECT doc, sheet, bool_or(m = 3) AND bool_or(m IN (6, 7)) AND sheet <> 'BUILDING' AS cover FROM k GROUP BY doc, sheet""")
def _(view, table):
    cells = _cover(view, table)
    return documents.cover_sheets(cells, cells.where("sheet = 'BUILDING'").groupBy("doc", "sheet").agg(F.min("row").alias("start")))


@query("cover_fields", COVER_SQL + """, l AS (SELECT doc, sheet, "row", t, CASE m WHEN 1 THEN 'phase' WHEN 2 THEN 'screen_id' WHEN 3 THEN 'doc_type' WHEN 4 THEN 'project' WHEN 5 THEN 'subsystem' ELSE 'screen_name' END AS field FROM c JOIN k USING (doc, sheet, "row") WHERE m NOT IN (6, 7))
 SELECT doc, sheet, field, CASE WHEN field = 'screen_name' THEN min_by(t, "row") ELSE max_by(t, "row") END AS value, min("row") AS ord FROM l GROUP BY doc, sheet, field
 UNION ALL SELECT doc, sheet, CASE m WHEN 6 THEN '作成者' ELSE '文書番号' END, min_by(c_name, "row"), min("row") FROM k WHERE m IN (6, 7) GROUP BY doc, sheet, m""")
def _(view, table):
    return documents.cover_fields(_cover(view, table))


@query("preview_crop", """, b AS (SELECT doc, sheet, min("row") AS r, min(col) AS c FROM v_cells WHERE col > 1 GROUP BY ALL) SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, display FROM v_cells JOIN b USING (doc, sheet) WHERE col > 1 AND "row" < r + 41 AND col < c + 3""")
def _(view, table):
    return documents.preview(view("cells").where("col > 1").select("doc", "sheet", "row", "col", "display"), 41, 3)


MD_LINES = """, t AS (SELECT doc, sheet, "row", string_agg('| ' || CASE WHEN col = 1 THEN upper(display) ELSE display END, ' ' ORDER BY col) AS line FROM v_cells WHERE col <= 2 GROUP BY ALL), s AS (SELECT doc, sheet, string_agg(line, chr(10) ORDER BY "row") || chr(10) AS content FROM t GROUP BY ALL)"""


def _contents(view):
    cells = view("cells").where("col <= 2")
    text = F.when(F.col("col") == 1, F.upper("display")).otherwise(F.col("display"))
    lines = cells.groupBy("doc", "sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.concat(F.lit("| "), text).alias("t")))), lambda x: x["t"]), " ").alias("line"))
    sheets = render.sheet_texts(lines.withColumn("ord", F.lit(0)))
    return sheets.select("doc").distinct().select("doc", F.concat(F.lit("<T> "), "doc").alias("title")), sheets


@query("md_document", MD_LINES + """ SELECT doc, '# <T> ' || doc || chr(10) || chr(10) || string_agg('- [' || sheet || '](#' || lower(sheet) || ')', chr(10) ORDER BY sheet) || chr(10) || string_agg(chr(10) || '## ' || sheet || chr(10) || chr(10) || content, '' ORDER BY sheet) AS content FROM s GROUP BY doc""")
def _(view, table):
    return documents.document_texts(*_contents(view))


@query("html_document", MD_LINES + """ SELECT doc, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>&lt;T&gt; ' || doc || '</title></head><body><h1>&lt;T&gt; ' || doc || '</h1><nav><ul>' || string_agg('<li><a href="#' || sheet || '">' || sheet || '</a></li>', '' ORDER BY sheet) || '</ul></nav>' || chr(10)
 || string_agg('<section id="' || sheet || '"><h2>' || sheet || '</h2><table>' || chr(10) || content || '</table></section>' || chr(10), '' ORDER BY sheet) || '</body></html>' || chr(10) AS content FROM s GROUP BY doc""")
def _(view, table):
    return documents.document_texts(*_contents(view), style="html")
