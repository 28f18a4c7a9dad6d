"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import a1, text, times
from gridloom.operators import captions, grid, jobs, render, rules, signals, template
from gridloom.plans import views
from gridloom.plans.views import VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Time of reference for due jobs, in milliseconds.
NOW = 5_000_000


def plain(df: DataFrame) -> DataFrame:
    """Integers of any width as long, so that both engines name the same types."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(lambda view: getattr(views, view)(spark, sf_dir), lambda t: views.table(spark, sf_dir, t)))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {VIEWS_SQL} {sql}" if "v_" in sql else sql
        return f

    return register


BLANK = "E' \\t\\n\\r'"
CLOCK = "printf('%02d:%02d:%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60)"
SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"

# Transcripts.


@query("transcript_export", f"""SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS idx, {SRT.format("start_ms")} AS "start", {SRT.format("greatest(end_ms, start_ms)")} AS "end",
 trim(text, {BLANK}) AS body FROM v_segments WHERE status <> 'Partial' AND trim(text, {BLANK}) <> ''""")
def _(view, table):
    return captions.srt(captions.persisted(view("segments"))).drop("cue")


@query("translation_srt", f"""SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS idx, {SRT.format("start_ms")} AS "start", {SRT.format("greatest(end_ms, start_ms)")} AS "end",
 trim(translation, {BLANK}) AS body FROM v_segments WHERE status <> 'Partial' AND translation IS NOT NULL AND trim(translation, {BLANK}) <> ''""")
def _(view, table):
    return captions.srt(captions.translated(view("segments")), "translation").drop("cue")


@query("transcript_txt", f"""SELECT session, string_agg('[' || {CLOCK.format("start_ms")} || '] ' || trim(text, {BLANK}) || chr(10), '' ORDER BY seq) AS content
 FROM v_segments WHERE status <> 'Partial' AND trim(text, {BLANK}) <> '' GROUP BY session""")
def _(view, table):
    return captions.document(captions.txt(captions.persisted(view("segments"))), "line")


@query("session_document", """SELECT s.session, s.state, s.language, coalesce(n, 0) AS segments, coalesce(t, false) AS translation_enabled,
 CASE WHEN t THEN 'ja' ELSE s.language END AS source, CASE WHEN t THEN 'zh' END AS target
 FROM v_sessions s LEFT JOIN (SELECT session, count(*) AS n, bool_or(translation IS NOT NULL) AS t FROM v_segments GROUP BY session) g USING (session)""")
def _(view, table):
    return captions.session_document(view("sessions"), view("segments"))


@query("session_history", """SELECT session, state, started_ms, (SELECT count(*) FROM v_segments g WHERE g.session = s.session) AS segments FROM v_sessions s ORDER BY started_ms DESC, session LIMIT 20""")
def _(view, table):
    return captions.history(view("sessions"), view("segments"), 20)


@query("incomplete_sessions", "SELECT * FROM v_sessions WHERE state NOT IN ('Completed', 'Recovered')")
def _(view, table):
    return captions.incomplete(view("sessions"))


@query("next_sequence", "SELECT session, coalesce(max(seq), 0) + 1 AS next_seq FROM v_segments GROUP BY session")
def _(view, table):
    return captions.next_sequence(view("segments"))


@query("segment_upsert", """SELECT session, id, seq, text, status FROM (
 SELECT session, id, seq, CASE WHEN seq % 3 = 0 THEN 'edited ' || text ELSE text END AS text, status FROM v_segments WHERE seq % 2 = 0 OR seq % 3 = 0 AND seq % 2 = 0
 UNION ALL SELECT session, id, (SELECT coalesce(max(seq), 0) FROM v_segments o WHERE o.session = v.session AND o.seq % 2 = 0) + row_number() OVER (PARTITION BY session ORDER BY seq) AS seq, 'edited ' || text, status
 FROM v_segments v WHERE seq % 3 = 0 AND seq % 2 = 1)""")
def _(view, table):
    rows = view("segments").select("session", "id", "seq", "text", "status")
    incoming = rows.where(F.col("seq") % 3 == 0).select("session", "id", F.col("seq").alias("at"), F.concat(F.lit("edited "), "text").alias("text"), "status")
    return captions.upsert(rows.where(F.col("seq") % 2 == 0), incoming, "at").select("session", "id", "seq", "text", "status")


@query("caption_search", "SELECT session, seq, text, translation FROM v_segments WHERE contains(lower(text), 'the') OR coalesce(contains(lower(translation), 'the'), false)")
def _(view, table):
    return captions.search(view("segments"), "  THE ").select("session", "seq", "text", "translation")


@query("playback_asof", """SELECT p.session, p.pos_ms, coalesce(c.seq, -1) AS seq, CASE WHEN p.pos_ms >= 3600000 THEN printf('%d:%02d:%02d', p.pos_ms // 3600000, p.pos_ms // 60000 % 60, p.pos_ms // 1000 % 60)
 ELSE printf('%02d:%02d', p.pos_ms // 60000 % 60, p.pos_ms // 1000 % 60) END AS at
 FROM (SELECT session, end_ms - 700 AS pos_ms FROM v_segments) p ASOF LEFT JOIN (SELECT session, start_ms + 1500 AS ms, seq FROM v_segments) c ON p.session = c.session AND p.pos_ms >= c.ms""")
def _(view, table):
    rows = view("segments")
    return captions.playback(rows.select("session", (F.col("end_ms") - 700).alias("pos_ms")), rows, 1.5)


@query("meeting_time_range", """SELECT session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, greatest(max(end_ms) - min(start_ms), 0) AS duration_ms, max(end_ms) > min(start_ms) AS has_valid
 FROM v_segments WHERE end_ms >= start_ms GROUP BY session""")
def _(view, table):
    return captions.time_range(view("segments"))


@query("summary_chunks", """, o AS (SELECT session, seq, length(text) AS n, start_ms, end_ms, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM v_segments WHERE status IN ('Final', 'Translated', 'TranslationFailed')),
 f AS (SELECT session, seq, n, start_ms, end_ms, i, 1 AS chunk, n AS held, n > 1200 AS oversize FROM o WHERE i = 1
 UNION ALL SELECT o.session, o.seq, o.n, o.start_ms, o.end_ms, o.i, f.chunk + CASE WHEN o.n > 1200 OR f.oversize OR f.held > 0 AND f.held + o.n > 1200 THEN 1 ELSE 0 END,
 CASE WHEN o.n > 1200 OR f.oversize OR f.held > 0 AND f.held + o.n > 1200 THEN o.n ELSE f.held + o.n END, o.n > 1200 FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1)
 SELECT session, CAST(chunk AS BIGINT) AS chunk, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS segments, CAST(sum(n) AS BIGINT) AS chars, bool_or(oversize) AS oversize, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms
 FROM f GROUP BY session, chunk""")
def _(view, table):
    return captions.summary_chunks(view("segments"), 1_200)


@query("monotone_clamp", """, s AS (SELECT session, seq, start_ms - 400 AS start_ms, end_ms FROM v_segments), t AS (SELECT session, seq, end_ms, greatest(start_ms, coalesce(max(end_ms) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms)) AS start_ms FROM s)
 SELECT session, seq, start_ms, greatest(end_ms, start_ms) AS end_ms FROM t""")
def _(view, table):
    return captions.monotone(view("segments").select("session", "seq", (F.col("start_ms") - 400).alias("start_ms"), "end_ms"))


@query("newest_lines", "SELECT session, seq, text FROM v_segments QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 3")
def _(view, table):
    return captions.newest_lines(view("segments"), 3).select("session", "seq", "text")


@query("translation_outcomes", """SELECT id, text, CASE WHEN seq % 4 = 0 THEN 'done' WHEN seq % 4 = 1 THEN translation ELSE translation END AS translation,
 CASE WHEN seq % 4 = 0 THEN 'Translated' WHEN seq % 4 = 1 THEN 'TranslationFailed' ELSE status END AS status FROM v_segments""")
def _(view, table):
    rows = view("segments")
    outcomes = rows.where(F.col("seq") % 4 <= 1).select("id", F.lit("done").alias("translation"), (F.col("seq") % 4 == 0).alias("ok"))
    return captions.apply_outcomes(rows, outcomes).select("id", "text", "translation", "status")


@query("recent_meetings", f"""SELECT s.session, s.state, {CLOCK.format("coalesce(d, 0)")} AS duration, s.state || ' · ' || {CLOCK.format("coalesce(d, 0)")} AS detail
 FROM v_sessions s LEFT JOIN (SELECT session, greatest(max(end_ms) - min(start_ms), 0) AS d FROM v_segments GROUP BY session) USING (session)""")
def _(view, table):
    return captions.recent_meetings(view("sessions"), view("segments"))


@query("cascade_delete", "SELECT session, seq FROM v_segments WHERE session % 5 <> 0")
def _(view, table):
    gone = view("sessions").where(F.col("session") % 5 == 0)
    return captions.delete_sessions({"segments": view("segments")}, gone)["segments"].select("session", "seq")


@query("orphan_rows", "SELECT session, seq FROM v_segments WHERE session NOT IN (SELECT session FROM v_sessions WHERE state = 'Completed')")
def _(view, table):
    return captions.orphans(view("segments"), view("sessions").where(F.col("state") == "Completed"), "session").select("session", "seq")


# The job queue.


@query("enqueue_candidates", """SELECT id FROM v_segments s WHERE status IN ('Final', 'TranslationFailed') AND lower(language) = 'ja' AND trim(text) <> '' AND coalesce(trim(translation), '') = ''
 AND NOT EXISTS (SELECT 1 FROM v_jobs j WHERE j.segment = s.id AND j.state IN ('Pending', 'InProgress', 'RetryScheduled'))""")
def _(view, table):
    return jobs.enqueue_candidates(view("segments"), view("jobs"), "JA", "zh").select("id")


@query("due_jobs", f"""SELECT job, least(pow(2.0, greatest(attempts, 1) - 1), 60.0) AS wait FROM v_jobs WHERE state IN ('Pending', 'RetryScheduled') AND coalesce(next_at, 0) <= {NOW}""")
def _(view, table):
    return jobs.due(view("jobs"), NOW).select("job", times.backoff_seconds(F.col("attempts")).alias("wait"))


@query("job_transitions", f""", r AS (SELECT *, state IN ('Pending', 'InProgress', 'RetryScheduled') AS act, state = 'InProgress' AS w, coalesce(state = 'InProgress' AND event = 'failure', false) AS failed, coalesce(error IN ('Timeout', 'RateLimited', 'ServiceUnavailable', 'Network') AND attempts + 1 <= 3, false) AS again FROM v_jobs),
 n AS (SELECT *, CASE WHEN NOT act THEN state WHEN event = 'disabled' THEN 'Cancelled' WHEN event = 'picked' AND state IN ('Pending', 'RetryScheduled') THEN 'InProgress' WHEN w AND event = 'success' THEN 'Succeeded'
 WHEN w AND event IN ('cancelled', 'restart') THEN 'Pending' WHEN failed AND again THEN 'RetryScheduled' WHEN failed THEN 'FailedPermanent' ELSE state END AS new_state, attempts + CASE WHEN failed THEN 1 ELSE 0 END AS new_attempts FROM r)
 SELECT job, new_state, new_attempts, CASE WHEN new_state = 'RetryScheduled' THEN CASE WHEN failed THEN {NOW} + CAST(least(pow(2.0, new_attempts - 1), 60.0) * 1000 AS BIGINT) ELSE next_at END END AS new_next_at,
 CASE WHEN new_state = 'Succeeded' AND event = 'success' THEN 'Translated' WHEN new_state = 'FailedPermanent' AND failed THEN 'TranslationFailed' END AS segment_status FROM n""")
def _(view, table):
    return jobs.transitions(view("jobs"), NOW).select("job", "new_state", "new_attempts", "new_next_at", "segment_status")


@query("unique_active_job", """SELECT segment, arg_min(job, ord) AS job FROM v_jobs WHERE ord % 2 = 1 AND segment NOT IN (SELECT segment FROM v_jobs WHERE ord % 2 = 0 AND state IN ('Pending', 'InProgress', 'RetryScheduled')) GROUP BY segment""")
def _(view, table):
    rows = view("jobs")
    return jobs.admit(rows.where(F.col("ord") % 2 == 0), rows.where(F.col("ord") % 2 == 1), "ord").select("segment", "job")


@query("crash_recovery", "SELECT job, CASE WHEN state = 'InProgress' THEN 'Pending' ELSE state END AS state FROM v_jobs")
def _(view, table):
    return jobs.recover(view("jobs")).select("job", "state")


# Grids.


@query("grid_densify", """, b AS (SELECT doc, sheet, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM v_cells GROUP BY doc, sheet),
 s AS (SELECT doc, sheet, r AS "row", unnest(range(c0, c1 + 1)) AS col FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM b)) SELECT s.doc, s.sheet, s."row", CAST(s.col AS BIGINT) AS col, c.display FROM s LEFT JOIN v_cells c ON c.doc = s.doc AND c.sheet = s.sheet AND c."row" = s."row" AND c.col = s.col""")
def _(view, table):
    return grid.densify(view("cells"))


MEMBER = """, m AS (SELECT c.*, g.r0 AS mr, g.c0 AS mc, g.r1, g.c1, k.display AS master FROM v_cells c LEFT JOIN v_merges g ON c.doc = g.doc AND c.sheet = g.sheet AND c."row" BETWEEN g.r0 AND g.r1 AND c.col BETWEEN g.c0 AND g.c1
 LEFT JOIN v_cells k ON k.doc = g.doc AND k.sheet = g.sheet AND k."row" = g.r0 AND k.col = g.c0)"""


@query("merge_expand", MEMBER + """ SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, mr, CAST(mc AS BIGINT) AS mc, master AS master_display, r1 - mr + 1 AS row_span, CAST(c1 - mc + 1 AS BIGINT) AS col_span FROM m WHERE mr IS NOT NULL""")
def _(view, table):
    return grid.merge_expand(view("cells"), view("merges"))


@query("merge_fill", MEMBER + """ SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, CASE WHEN mr IS NOT NULL THEN master ELSE display END AS display FROM m""")
def _(view, table):
    return grid.merge_fill(view("cells"), view("merges"))


@query("merge_blank", MEMBER + """ SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, CASE WHEN mr IS NOT NULL AND NOT (mr = "row" AND mc = col) THEN '' ELSE display END AS display FROM m""")
def _(view, table):
    return grid.merge_blank(view("cells"), view("merges"))


@query("sheet_bounds", """SELECT doc, sheet, min("row") AS r0, CAST(min(col) AS BIGINT) AS c0, max("row") AS r1, CAST(max(col) AS BIGINT) AS c1 FROM v_cells GROUP BY doc, sheet""")
def _(view, table):
    return grid.bounds(view("cells"))


@query("sheet_profile", """, p AS (SELECT *, row_number() OVER (PARTITION BY doc, sheet ORDER BY "row", col) AS place FROM v_cells WHERE trim(display) <> ''),
 q AS (SELECT doc, sheet, count(*) FILTER (place <= 80) AS sampled, least(count(*) FILTER ("row" <= 20 AND length(display) <= 40), 40) AS header_candidates, arg_min(display, place) AS first_text FROM p GROUP BY doc, sheet)
 SELECT doc, sheet, c.cells, c.non_blank, coalesce(sampled, 0) AS sampled, coalesce(header_candidates, 0) AS header_candidates, first_text FROM (SELECT doc, sheet, count(*) AS cells, count(*) FILTER (trim(display) <> '') AS non_blank FROM v_cells GROUP BY doc, sheet) c LEFT JOIN q USING (doc, sheet)""")
def _(view, table):
    return grid.profile(view("cells"))


BANDS = """, fr AS (SELECT doc, sheet, "row", bool_or(bold) AS heading FROM v_cells WHERE trim(display) <> '' GROUP BY ALL), fn AS (SELECT *, CASE WHEN coalesce("row" - lag("row") OVER w > 1, true) OR heading THEN 1 ELSE 0 END AS n FROM fr WINDOW w AS (PARTITION BY doc, sheet ORDER BY "row")),
 bands AS (SELECT doc, sheet, CAST(band AS BIGINT) AS band, min("row") AS r0, max("row") AS r1 FROM (SELECT *, sum(n) OVER (PARTITION BY doc, sheet ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS band FROM fn) GROUP BY doc, sheet, band)"""


@query("row_bands", BANDS + " SELECT * FROM bands")
def _(view, table):
    return grid.row_bands(view("cells"))


@query("column_islands", BANDS + """, k AS (SELECT DISTINCT b.doc, b.sheet, band, r0, r1, col FROM bands b JOIN v_cells c ON b.doc = c.doc AND b.sheet = c.sheet AND c."row" BETWEEN r0 AND r1 WHERE trim(display) <> ''),
 n AS (SELECT *, CASE WHEN coalesce(col - lag(col) OVER (PARTITION BY doc, sheet, band ORDER BY col) > 1, true) THEN 1 ELSE 0 END AS n FROM k), s AS (SELECT *, sum(n) OVER (PARTITION BY doc, sheet, band ORDER BY col ROWS UNBOUNDED PRECEDING) AS island FROM n)
 SELECT doc, sheet, band, CAST(island AS BIGINT) AS island, r0, r1, CAST(min(col) AS BIGINT) AS c0, CAST(max(col) AS BIGINT) AS c1 FROM s GROUP BY ALL""")
def _(view, table):
    return grid.column_islands(view("cells"))


@query("row_clusters", """, k AS (SELECT DISTINCT doc, sheet, "row" FROM v_cells WHERE trim(display) <> ''), n AS (SELECT *, CASE WHEN coalesce("row" - lag("row") OVER (PARTITION BY doc, sheet ORDER BY "row") > 2, true) THEN 1 ELSE 0 END AS n FROM k)
 SELECT doc, sheet, CAST(cluster AS BIGINT) AS cluster, min("row") AS r0, max("row") AS r1, count(*) AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY doc, sheet ORDER BY "row" ROWS UNBOUNDED PRECEDING) AS cluster FROM n) GROUP BY doc, sheet, cluster""")
def _(view, table):
    return grid.row_clusters(view("cells"))


@query("blank_run_cut", """, b AS (SELECT doc, sheet, min("row") AS r0, max("row") AS r1 FROM v_cells GROUP BY ALL), e AS (SELECT doc, sheet, "row", "row" - row_number() OVER (PARTITION BY doc, sheet ORDER BY "row") AS g FROM (SELECT doc, sheet, "row" FROM v_cells GROUP BY ALL HAVING bool_and(trim(display) = ''))),
 f AS (SELECT doc, sheet, min(a) AS a FROM (SELECT doc, sheet, g, min("row") AS a FROM e GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL) SELECT doc, sheet, r0, greatest(r0, coalesce(a - 1, r1)) AS r1 FROM b LEFT JOIN f USING (doc, sheet)""")
def _(view, table):
    return grid.blank_run_cut(view("cells"), 2)


@query("shrink_to_content", """SELECT doc, sheet, min(c."row") AS r0, CAST(min(col) AS BIGINT) AS c0, max(c."row") AS r1, CAST(max(col + CASE WHEN col = 1 AND c."row" % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c1 FROM v_cells c WHERE trim(display) <> '' AND col <= 2 GROUP BY doc, sheet""")
def _(view, table):
    span = F.when((F.col("col") == 1) & (F.col("row") % 10 == 1), 2).otherwise(1)
    return grid.shrink_to_content(view("cells").where("col <= 2").withColumn("row_span", F.lit(1)).withColumn("col_span", span))


@query("drop_empty_columns", """SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, display FROM v_cells c WHERE EXISTS (SELECT 1 FROM v_cells d WHERE d.doc = c.doc AND d.sheet = c.sheet AND d.col = c.col AND trim(d.display) <> '')""")
def _(view, table):
    return grid.drop_empty_columns(view("cells")).select("doc", "sheet", "row", "col", "display")


LABELS = """, u AS (SELECT doc, sheet, col, trim(display) AS t, min("row") AS r FROM v_cells WHERE "row" BETWEEN 1 AND 3 AND trim(display) <> '' GROUP BY ALL), labels AS (SELECT doc, sheet, CAST(col AS BIGINT) AS col, string_agg(t, ' / ' ORDER BY r) AS label FROM u GROUP BY doc, sheet, col)"""


@query("header_labels", LABELS + " SELECT * FROM labels")
def _(view, table):
    return grid.header_labels(view("cells"), 1, 3)


MAPPING = [("2", "nation"), ("A", "customer"), ("mark.*BUILD", "building"), ("mark", "marked"), ("-", "balance")]


@query("column_semantics", LABELS + r""", i AS (SELECT *, row_number() OVER (PARTITION BY doc, sheet ORDER BY col) AS i, chr(CAST(64 + col AS INTEGER)) AS l FROM labels),
 s AS (SELECT doc, sheet, col, CASE WHEN i = 2 THEN 'nation' WHEN l = 'A' THEN 'customer' WHEN label = '-' THEN 'balance' WHEN label = 'mark' THEN 'marked' WHEN regexp_matches(label, '2') THEN 'nation' WHEN regexp_matches(label, '(?i)a') AND true THEN CASE WHEN true THEN 'customer' END
 WHEN regexp_matches(label, '(?i)mark.*BUILD') THEN 'building' WHEN regexp_matches(label, '(?i)mark') THEN 'marked' WHEN regexp_matches(label, '-') THEN 'balance' END AS semantic FROM i)
 SELECT doc, sheet, min(col) AS col, semantic FROM s WHERE semantic IS NOT NULL GROUP BY doc, sheet, semantic""")
def _(view, table):
    return template.column_semantics(grid.header_labels(view("cells"), 1, 3), MAPPING)


@query("key_values", r""", p AS (SELECT k.doc, k.sheet, k."row" AS ord, trim(k.display) AS key, v.display AS value FROM v_cells k LEFT JOIN v_cells v ON v.doc = k.doc AND v.sheet = k.sheet AND v."row" = k."row" AND v.col = 3 WHERE k.col = 2 AND trim(k.display) <> ''),
 n AS (SELECT *, CASE WHEN regexp_matches(key, '7') THEN 'seven' WHEN regexp_matches(key, '^1') THEN 'ones' ELSE key END AS name FROM p) SELECT doc, sheet, name, arg_max(value, ord) AS value FROM n GROUP BY doc, sheet, name""")
def _(view, table):
    return template.key_semantics(template.key_values(view("cells"), 2, 3), [("7", "seven"), ("^1", "ones")])


@query("anchor_regions", """, a AS (SELECT doc, sheet, "row", col, row_number() OVER w AS n, lead("row") OVER w AS nxt FROM v_cells WHERE trim(display) = '6' OR regexp_matches(display, '(?i)^mark') AND false WINDOW w AS (PARTITION BY doc, sheet ORDER BY "row", col)),
 b AS (SELECT doc, sheet, min("row") AS s0, min(col) AS k0, max("row") AS s1, max(col) AS k1 FROM v_cells GROUP BY ALL),
 r AS (SELECT a.doc, a.sheet, n, nxt, greatest(s0, a."row" + 1) AS r0, greatest(k0, a.col - 1) AS c0, s1, k1 FROM a JOIN b USING (doc, sheet)),
 e AS (SELECT r.doc, r.sheet, n, min(c."row") AS e FROM r JOIN v_cells c ON c.doc = r.doc AND c.sheet = r.sheet AND trim(c.display) = '3' AND c."row" > r0 AND (nxt IS NULL OR c."row" < nxt) GROUP BY ALL)
 SELECT r.doc, r.sheet, 'block' AS region_id, r.n, r0, CAST(c0 AS BIGINT) AS c0, greatest(coalesce(e - 1, nxt - 1, greatest(r0, s1)), r0) AS r1, CAST(greatest(greatest(c0, k1), c0) AS BIGINT) AS c1 FROM r LEFT JOIN e ON e.doc = r.doc AND e.sheet = r.sheet AND e.n = r.n""")
def _(view, table):
    return template.locate(view("cells"), template.Region("block", anchor_text="6", end_text="3", row_offset=1, col_offset=-1, repeat=True))


@query("rect_overlap_claim", """, a AS (SELECT doc, sheet, doc || sheet || "row" AS asset_id, "row" AS r0, 2 AS c0, "row" + 3 AS r1, 3 AS c1 FROM v_grid WHERE "row" % 7 = 0),
 g AS (SELECT DISTINCT doc, sheet, unnest([{'id': 'unrecognized-1', 'o': 0, 'k': 'x', 'r0': 1, 'r1': 90}, {'id': 'head', 'o': 1, 'k': 'table', 'r0': 5, 'r1': 9}, {'id': 'mid', 'o': 2, 'k': 'table', 'r0': 8, 'r1': 30}, {'id': 'rest', 'o': 3, 'k': 'layout', 'r0': 31, 'r1': 33}]) AS g FROM v_grid),
 h AS (SELECT a.*, (SELECT arg_min(g.g.id, g.g.o) FROM g WHERE g.doc = a.doc AND g.sheet = a.sheet AND g.g.id NOT LIKE 'unrecognized%' AND a.r0 <= g.g.r1 AND g.g.r0 <= a.r1) AS hit FROM a) SELECT doc, sheet, asset_id, coalesce(hit, 'rest') AS region_id FROM h""")
def _(view, table):
    cells = view("cells").where("col = 1")
    assets = cells.where("row % 7 = 0").select("doc", "sheet", F.concat("doc", "sheet", F.col("row").cast("string")).alias("asset_id"), F.col("row").alias("r0"), F.lit(2).alias("c0"), (F.col("row") + 3).alias("r1"), F.lit(3).alias("c1"))
    boxes = [("unrecognized-1", 0, "x", 1, 90), ("head", 1, "table", 5, 9), ("mid", 2, "table", 8, 30), ("rest", 3, "layout", 31, 33)]
    own = F.array(*[F.struct(F.lit(n).alias("region_id"), F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(a).alias("r0"), F.lit(1).alias("c0"), F.lit(b).alias("r1"), F.lit(6).alias("c1")) for n, o, k, a, b in boxes])
    regions = cells.select("doc", "sheet").distinct().select("doc", "sheet", F.explode(own).alias("g")).select("doc", "sheet", "g.*")
    return template.claim_assets(assets, regions)


@query("uncovered_cells", """SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, display FROM v_cells WHERE trim(display) <> '' AND NOT ("row" BETWEEN 1 AND 20 AND col BETWEEN 1 AND 3)""")
def _(view, table):
    cells = view("cells")
    regions = cells.select("doc", "sheet").distinct().select("doc", "sheet", F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(20).alias("r1"), F.lit(3).alias("c1"))
    return grid.uncovered(cells, regions).select("doc", "sheet", "row", "col", "display")


TEMPLATES = [
    template.Template("customers", "1", ("BUILD", "^HOUSE"), (template.Fingerprint({(1, 1): "Customer#000000003", (2, 2): "7"}, ("customer#",), 2.0), template.Fingerprint({}, ("mark|BUILDING", "nothing"), 1.0, "building"))),
    template.Template("others", "2", ("^NONE$",), (template.Fingerprint({(1, 2): "19"}, (), 1.0),)),
]


@query("template_score", """, t AS (SELECT doc, sheet, bool_or("row" = 1 AND col = 1 AND trim(display) = 'Customer#000000003') AS a, bool_or("row" = 2 AND col = 2 AND trim(display) = '7') AS b, bool_or(contains(lower(display), 'customer#')) AS c,
 bool_or(contains(lower(display), 'mark|building')) AND regexp_matches(sheet, '(?i)building') AS d, bool_or(contains(lower(display), 'nothing')) AND regexp_matches(sheet, '(?i)building') AS e, bool_or("row" = 1 AND col = 2 AND trim(display) = '19') AS f,
 regexp_matches(sheet, '(?i)BUILD') AS s1, regexp_matches(sheet, '(?i)^HOUSE') AS s2, regexp_matches(sheet, '(?i)^NONE$') AS s3 FROM v_cells GROUP BY doc, sheet),
 m AS (SELECT doc, max((a::INT + b::INT + c::INT) / 3.0::DOUBLE) AS p1, max((d::INT + e::INT) / 2.0::DOUBLE) AS p2, max(f::INT)::DOUBLE AS p3, (bool_or(s1)::INT + bool_or(s2)::INT) / 2.0::DOUBLE AS n1, bool_or(s3)::INT::DOUBLE AS n2 FROM t GROUP BY doc),
 r AS (SELECT doc, 'customers' AS template_id, '1' AS version, round_even(n1 * 0.35::DOUBLE + (p1 * 2 + p2) / 3.0::DOUBLE * 0.65::DOUBLE, 6) AS score FROM m UNION ALL SELECT doc, 'others', '2', round_even(n2 * 0.35::DOUBLE + p3 * 0.65::DOUBLE, 6) FROM m),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, template_id, version) AS place FROM r) SELECT *, coalesce(score >= 0.6 AND place = min(CASE WHEN score >= 0.6 THEN place END) OVER (PARTITION BY doc), false) AS accepted FROM o""")
def _(view, table):
    return template.match(view("cells"), TEMPLATES, 0.6).withColumn("accepted", F.coalesce("accepted", F.lit(False)))


@query("region_extract", """, h AS (SELECT doc, sheet, min("row") AS a FROM v_cells WHERE trim(display) = '7' GROUP BY ALL), x AS (SELECT c.*, CASE WHEN c."row" BETWEEN 1 AND 2 AND c.col BETWEEN 1 AND 6 THEN 'title' WHEN c."row" BETWEEN a AND a + 4 THEN 'block' WHEN c."row" BETWEEN 40 AND 45 AND c.col BETWEEN 1 AND 2 THEN 'gone' ELSE 'unrecognized' END AS region FROM v_cells c LEFT JOIN h USING (doc, sheet)),
 y AS (SELECT x.*, k.col AS ac FROM x LEFT JOIN (SELECT doc, sheet, arg_min(col, "row" * 100 + col) AS col FROM v_cells WHERE trim(display) = '7' GROUP BY ALL) k USING (doc, sheet)),
 z AS (SELECT doc, sheet, "row", col, display, CASE WHEN region = 'block' AND col < ac THEN CASE WHEN "row" BETWEEN 40 AND 45 AND col BETWEEN 1 AND 2 THEN 'gone' ELSE 'unrecognized' END ELSE region END AS region FROM y)
 SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, display, region FROM z WHERE region <> 'gone'""")
def _(view, table):
    regions = (template.Region("title", range=(1, 1, 2, 6), order=1), template.Region("block", anchor_text="7", height=5, order=2), template.Region("gone", range=(40, 1, 45, 2), order=3, ignore=True))
    return template.extract(view("cells"), regions).select("doc", "sheet", "row", "col", "display", "region")


@query("main_table_start", """, f AS (SELECT doc, sheet, "row", count(*) AS n, bool_or(contains(display, 'mark'))::INT + bool_or(contains(display, '#'))::INT AS h FROM v_cells WHERE trim(display) <> '' GROUP BY ALL), t AS (SELECT doc, sheet, min("row") AS r0 FROM v_cells GROUP BY ALL),
 g AS (SELECT f.*, r0, coalesce(max((n >= 2)::INT) OVER (PARTITION BY doc, sheet ORDER BY "row" RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) = 1 AS fuller, n >= 5 AND h >= 2 AS head FROM f JOIN t USING (doc, sheet)),
 m AS (SELECT doc, sheet, greatest(6, list_sort(list(n))[count(*) // 2 + 1] + 3) AS lim FROM g WHERE "row" < r0 + 30 GROUP BY ALL)
 SELECT g.doc, g.sheet, coalesce(min(CASE WHEN head THEN "row" END), min(CASE WHEN "row" < r0 + 30 AND n >= lim AND fuller THEN "row" END)) AS start FROM g LEFT JOIN m USING (doc, sheet) GROUP BY ALL""")
def _(view, table):
    return grid.main_table_start(view("cells"), ["mark", "#"])


@query("label_value_pairs", """, f AS (SELECT doc, sheet, "row", col, trim(display) AS t, lead(trim(display)) OVER (PARTITION BY doc, sheet, "row" ORDER BY col) AS value FROM v_cells WHERE trim(display) <> '') SELECT doc, sheet, "row", CAST(col AS BIGINT) AS col, t AS label, value FROM f WHERE t IN ('7', '3', '12') AND value IS NOT NULL AND value NOT IN ('7', '3', '12')""")
def _(view, table):
    return grid.label_values(view("cells"), ["7:", "3", "12"])


@query("output_names", """SELECT doc, sheet, regexp_replace(sheet, '[<>:"/\\\\|?*]', '_', 'g') AS file FROM (SELECT DISTINCT doc, sheet FROM v_cells)""")
def _(view, table):
    return render.output_names(view("cells"))


# Rendering.

ROWS = """, w AS (SELECT doc, sheet, "row", [coalesce(max(CASE WHEN col = 1 THEN display END), ''), coalesce(max(CASE WHEN col = 2 THEN display END), ''), coalesce(max(CASE WHEN col = 3 THEN display END), ''), coalesce(max(CASE WHEN col = 4 THEN display END), ''), '', coalesce(max(CASE WHEN col = 6 THEN display END), '')] AS t
 FROM v_cells GROUP BY ALL HAVING bool_or(trim(display) <> ''))"""


@query("md_rows", ROWS + r""", l AS (SELECT doc, sheet, "row", 0 AS ord, '| ' || array_to_string(list_transform(t, lambda x: replace(replace(x, '\', '\\'), '|', '\|')), ' | ') || ' |' AS line FROM w)
 SELECT doc, sheet, "row", CAST(ord AS BIGINT) AS ord, line FROM (SELECT * FROM l UNION ALL SELECT doc, sheet, min("row"), 1, '| --- | --- | --- | --- | --- | --- |' FROM l GROUP BY doc, sheet)""")
def _(view, table):
    return render.markdown_rows(view("cells"))


@query("csv_rows", ROWS + """ SELECT doc, sheet, "row", CAST(0 AS BIGINT) AS ord, array_to_string(t, ',') AS line FROM w""")
def _(view, table):
    return render.csv_rows(view("cells"))


@query("html_rows", """, c AS (SELECT c.doc, c.sheet, c."row", c.col, '<td data-cell="' || chr(64 + c.col) || c."row" || '"' || CASE WHEN c.col = 1 AND c."row" % 10 = 1 THEN ' colspan="2"' ELSE '' END || '>' || c.display || '</td>' AS td FROM v_cells c WHERE NOT (c.col = 2 AND c."row" % 10 = 1))
 SELECT doc, sheet, "row", CAST(0 AS BIGINT) AS ord, '<tr>' || string_agg(td, '' ORDER BY col) || '</tr>' AS line FROM c GROUP BY doc, sheet, "row\"""")
def _(view, table):
    return render.html_rows(view("cells"), view("merges"))


@query("kb_rows", LABELS + """, k AS (SELECT c.doc, c.sheet, c."row", c.col, coalesce(l.label, chr(64 + c.col)) || ': ' || trim(c.display) AS line FROM v_cells c LEFT JOIN labels l ON l.doc = c.doc AND l.sheet = c.sheet AND l.col = c.col WHERE c."row" > 3 AND trim(c.display) <> '')
 SELECT doc, sheet, "row", doc || ':' || sheet || ':row-' || "row" AS chunk_id, string_agg(line, chr(10) ORDER BY col) AS text FROM k GROUP BY doc, sheet, "row\"""")
def _(view, table):
    cells = view("cells")
    return render.knowledge_rows(cells, grid.header_labels(cells, 1, 3), 3)


#: What Spark's (?U)\\s matches, for DuckDB.
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("text_split", rf"""WITH RECURSIVE t AS (SELECT CAST(doc_id AS VARCHAR) AS k, text FROM documents WHERE length(text) > 1000),
 p AS (SELECT k, 0 AS n, CAST(NULL AS VARCHAR) AS body, text AS rest FROM t
 UNION ALL SELECT k, n + 1, regexp_replace(left(rest, c), '{WHITE}+$', ''), regexp_replace(substr(rest, c + 1), '^{WHITE}+', '') FROM (SELECT k, n, rest,
  CASE WHEN l > 0 THEN l WHEN b > 0 THEN b ELSE 1000 END AS c FROM (SELECT k, n, rest, length(regexp_extract(w, '^((?s:.*))\n', 1)) AS l, length(regexp_extract(w, '^((?s:.*)) ', 1)) AS b FROM (SELECT k, n, rest, left(rest, 1001) AS w FROM p WHERE rest <> '')))),
 q AS (SELECT k, body, row_number() OVER (PARTITION BY k ORDER BY n) AS part FROM p WHERE body <> '')
 SELECT k || ':part-' || part AS chunk_id, part, body FROM q UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, text FROM documents WHERE length(text) <= 1000""")
def _(view, table):
    return render.chunk_texts(table("documents"), "doc_id", "text", 1_000)


@query("interleave_blocks", """, a AS (SELECT doc, sheet, CASE WHEN "row" % 28 = 0 THEN 2147483647 ELSE "row" END AS r, 1 AS k, "row" AS o, 'asset' AS kind, doc || '/' || "row" AS item FROM v_grid WHERE "row" % 14 = 0 UNION ALL SELECT doc, sheet, "row", 0, 0, 'text', display FROM v_cells WHERE col = 1 AND trim(display) <> '')
 SELECT doc, sheet, row_number() OVER (PARTITION BY doc, sheet ORDER BY r, k, o, item) AS place, kind, r AS "row", item FROM a""")
def _(view, table):
    cells = view("cells").where("col = 1")
    lines = cells.where(grid.has_text(F.col("display"))).select("doc", "sheet", "row", F.col("display").alias("line"))
    assets = cells.where("row % 14 = 0").select("doc", "sheet", F.when(F.col("row") % 28 != 0, F.col("row")).alias("row"), F.col("row").alias("ord"), F.concat("doc", F.lit("/"), F.col("row").cast("string")).alias("asset_id"))
    return render.interleave(lines, assets)


# Rules.


@query("rule_required", "SELECT 'required' AS rule, 'business.required' AS code, 'error' AS severity, 'o_orderpriority' AS value, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 HAVING count(*) > 0")
def _(view, table):
    rows = table("orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.lit("set")))
    return rules.required(rows, "o_orderpriority")


@query("rule_regex", "SELECT 'regex' AS rule, 'business.regex' AS code, 'error' AS severity, c_name AS value, count(*) AS n FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') GROUP BY c_name")
def _(view, table):
    return rules.regex(table("customer"), "c_name", "[02468]$")


@query("rule_enum", "SELECT 'enum' AS rule, 'business.enum' AS code, 'warning' AS severity, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY o_orderstatus")
def _(view, table):
    return rules.enum(table("orders"), "o_orderstatus", ["O", "F"], severity="warning")


@query("rule_unique", "SELECT 'unique' AS rule, 'business.unique' AS code, 'error' AS severity, CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(view, table):
    return rules.unique(table("orders"), "o_custkey")


@query("rule_reference", "SELECT 'reference' AS rule, 'business.reference' AS code, 'error' AS severity, CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY o_custkey")
def _(view, table):
    return rules.reference(table("orders"), "o_custkey", table("customer").where("c_nationkey < 12"), "c_custkey")


@query("rule_summary", """SELECT CAST(0 AS BIGINT) AS errors, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) AS warnings, CAST(0 AS BIGINT) AS infos, true AS valid""")
def _(view, table):
    return rules.summary(rules.enum(table("orders"), "o_orderstatus", ["O", "F"], severity="warning"))


@query("workbook_compare", """, h AS (SELECT DISTINCT CAST(substr(doc, 4) AS BIGINT) AS pair, sheet, display AS h FROM v_cells WHERE col = 2), l AS (SELECT * FROM h WHERE sheet <> 'MACHINERY' OR pair % 2 = 1), r AS (SELECT pair - 1 AS pair, sheet, h FROM h WHERE pair > 0 AND (sheet <> 'BUILDING' OR pair % 2 = 0)),
 m AS (SELECT max(pair) AS m FROM h), s AS (SELECT DISTINCT pair, sheet FROM (SELECT pair, sheet FROM l UNION ALL SELECT pair, sheet FROM r)), d AS (SELECT pair, sheet, (pair, sheet) IN (SELECT (pair, sheet) FROM l) AS il, (pair, sheet) IN (SELECT (pair, sheet) FROM r) AS ir,
 coalesce((SELECT string_agg(h, '|' ORDER BY h) FROM l WHERE l.pair = s.pair AND l.sheet = s.sheet AND NOT EXISTS (SELECT 1 FROM r WHERE r.pair = l.pair AND r.sheet = l.sheet AND r.h = l.h)), '') AS only_left,
 coalesce((SELECT string_agg(h, '|' ORDER BY h) FROM r WHERE r.pair = s.pair AND r.sheet = s.sheet AND NOT EXISTS (SELECT 1 FROM l WHERE r.pair = l.pair AND r.sheet = l.sheet AND r.h = l.h)), '') AS only_right FROM s)
 SELECT pair, sheet, CASE WHEN il AND ir THEN 'shared' WHEN il THEN 'left' ELSE 'right' END AS side, only_left, only_right, il AND ir AND only_left = '' AND only_right = '' AS similar FROM d""")
def _(view, table):
    """Every workbook against its successor; of even ones a sheet is missing on the left, of odd ones on the right."""
    pair = F.substring("doc", F.lit(4), F.length("doc")).cast("long")
    heads = view("cells").where("col = 2").select(pair.alias("pair"), "sheet", F.col("display").alias("header"))
    left = heads.where("sheet <> 'MACHINERY' or pair % 2 = 1")
    right = heads.where("pair > 0 and (sheet <> 'BUILDING' or pair % 2 = 0)").withColumn("pair", F.col("pair") - 1)
    return rules.compare_sheets(left, right, ("pair", "sheet"))


# Signals.


@query("vad_utterances", """, l AS (SELECT session, ms, id, CASE WHEN coalesce(ms - lag(ms) OVER w >= 21600000, true) THEN 1 ELSE 0 END AS n FROM v_samples WHERE rms >= 0.012 WINDOW w AS (PARTITION BY session ORDER BY ms, id)),
 u AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS utterance FROM l) SELECT session, CAST(utterance AS BIGINT) AS utterance, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS samples FROM u GROUP BY session, utterance""")
def _(view, table):
    return signals.utterances(view("samples"), 6 * 3_600_000)


@query("finalise_reason", """SELECT id, CASE WHEN id % 13 = 0 THEN 'None' WHEN id % 17 = 0 THEN 'Flush' WHEN id % 15 >= 12 THEN 'MaxLength' WHEN id % 23 >= 20 THEN 'MaxWait' WHEN id % 900 >= 700 THEN 'Silence' WHEN id % 2 = 0 AND id % 5 >= 2 THEN 'Punctuation' ELSE 'None' END AS reason FROM v_samples""")
def _(view, table):
    i = F.col("id")
    return view("samples").select("id", signals.finalise_reason(i % 13 != 0, i % 17 == 0, i % 15, i % 23, i % 900, i % 2 == 0, i % 5).alias("reason"))


@query("gap_fill_frames", """, s AS (SELECT session, unnest(range(0, max(frame) + 1)) AS frame FROM v_frames GROUP BY session) SELECT s.session, k.stream, CAST(s.frame AS BIGINT) AS frame, coalesce(f.sample, 0) AS sample, f.sample IS NULL AS filled FROM s JOIN (SELECT DISTINCT session, stream FROM v_frames) k USING (session) LEFT JOIN v_frames f ON f.session = s.session AND f.stream = k.stream AND f.frame = s.frame""")
def _(view, table):
    return signals.gap_fill(view("frames"))


@query("mix_frames", """SELECT session, CAST(frame AS BIGINT) AS frame, greatest(least(CAST(sum(sample) AS BIGINT), 32767), -32768) AS sample, sum(sample) > 32767 AS clipped FROM v_frames GROUP BY session, frame""")
def _(view, table):
    rows = view("frames")
    return signals.mix(rows.where("stream = 'system'"), rows.where("stream = 'mic'"))


@query("jitter_drop_oldest", """SELECT session, least(count(*), 12) AS kept, greatest(count(*) - 12, 0) AS dropped FROM v_frames GROUP BY session""")
def _(view, table):
    return signals.drop_oldest(view("frames"), 12)


@query("health_rollup", """SELECT user_id, CASE max(CASE WHEN value < 5 THEN 2 WHEN value >= 90 THEN 1 ELSE 0 END) WHEN 2 THEN 'LowDisk' WHEN 1 THEN 'HighCpu' ELSE 'Normal' END AS worst, bool_or(event_type = 'error') AS blocked, count(*) AS samples FROM events GROUP BY user_id""")
def _(view, table):
    state = signals.health(F.col("value"), F.col("value"), 5.0)
    order = F.when(state == "LowDisk", 2).when(state == "HighCpu", 1).otherwise(0)
    worst = F.element_at(F.array(*map(F.lit, ("Normal", "HighCpu", "LowDisk"))), F.max(order) + 1)
    return table("events").groupBy("user_id").agg(worst.alias("worst"), F.bool_or(F.col("event_type") == "error").alias("blocked"), F.count("*").alias("samples"))


@query("cpu_rate", """SELECT session AS key, id, CASE WHEN ms - lag(ms) OVER w > 0 THEN round(greatest((value - lag(value) OVER w) / ((ms - lag(ms) OVER w) / 1000.0::DOUBLE), 0), 9) END AS rate FROM v_samples WINDOW w AS (PARTITION BY session ORDER BY ms, id)""")
def _(view, table):
    rows = signals.rate(view("samples").select(F.col("session").alias("key"), "ms", "id", "value"))
    return rows.withColumn("rate", F.round("rate", 9))


@query("level_smoothing", """, o AS (SELECT session, id AS ord, value AS level, row_number() OVER (PARTITION BY session ORDER BY id) AS i FROM v_samples), f AS (SELECT session, ord, level, i, CASE WHEN level >= 0 THEN level ELSE level * 0.2::DOUBLE END AS shown FROM o WHERE i = 1
 UNION ALL SELECT o.session, o.ord, o.level, o.i, CASE WHEN o.level >= f.shown THEN o.level ELSE f.shown * 0.8::DOUBLE + o.level * 0.2::DOUBLE END FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1) SELECT session, ord, level, round(shown, 6) AS shown FROM f""")
def _(view, table):
    rows = signals.smooth(view("samples").select("session", F.col("id").alias("ord"), F.col("value").alias("level")))
    return rows.withColumn("shown", F.round("shown", 6))


# Texts and messages.


@query("secret_scan", r"""SELECT doc_id, CAST(line AS BIGINT) AS line, pattern FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), (VALUES ('bearer-token', '(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._\-]{12,}'),
 ('api-key-assignment', '(?i)\bapi[-_]?key\b["'']?\s*[:=]\s*["'']?[A-Za-z0-9]{16,}'), ('openai-style-key', '\bsk-[A-Za-z0-9]{16,}\b'), ('e-mail', '[a-z0-9.]+@[a-z0-9]+\.example\.com')) AS p(pattern, rx) WHERE regexp_matches(t, rx)""")
def _(view, table):
    return secret_scan(table("documents"))


#: The patterns of the scan, and one for addresses.
SECRETS = {
    "bearer-token": r"(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._\-]{12,}",
    "api-key-assignment": r"""(?i)\bapi[-_]?key\b["']?\s*[:=]\s*["']?[A-Za-z0-9]{16,}""",
    "openai-style-key": r"\bsk-[A-Za-z0-9]{16,}\b",
    "e-mail": r"[a-z0-9.]+@[a-z0-9]+\.example\.com",
}


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, line, pattern) for each line (from 1) in which a pattern is found."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    found = F.array_compact(F.array(*[F.when(F.col("t").rlike(rx), F.lit(name)) for name, rx in SECRETS.items()]))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), F.explode(found).alias("pattern"))


@query("stabilise_lcp", rf"""WITH p AS (SELECT doc_id, ord, regexp_replace(regexp_replace(left(text, (length(text) * ord + 5) // 6), '^{WHITE}+', ''), '{WHITE}+$', '') AS t FROM documents, range(1, 7) AS u(ord)),
 f AS (SELECT doc_id, ord, t, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY ord), '') AS before FROM p) SELECT doc_id AS session, ord, before AS committed, t AS partial FROM f""")
def _(view, table):
    """Every text in six growing parts, the last of them the whole: what two agree on is committed."""
    from gridloom.streaming.captions import stabilise_batch

    docs = table("documents").select(F.col("doc_id").alias("session"), F.coalesce("text", F.lit("")).alias("t"))
    steps = docs.select("session", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ord"), "t")
    return stabilise_batch(steps.select("session", F.col("ord").cast("long").alias("ord"), F.expr("left(t, (length(t) * ord + 5) div 6)").alias("text")))


@query("common_prefix", rf"""WITH p AS (SELECT doc_id, regexp_replace(text, '{WHITE}', '', 'g') AS a, regexp_replace(left(text, length(text) // 2) || 'zz', '{WHITE}', '', 'g') AS b FROM documents),
 q AS (SELECT doc_id, a, b, list_position(list_transform(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false) AS i FROM p)
 SELECT doc_id, CASE WHEN coalesce(a, '') = '' THEN 0 WHEN i > 0 THEN i - 1 ELSE length(a) END AS n FROM q""")
def _(view, table):
    """Each text against its first half with other letters after it."""
    pair = F.array("text", F.concat(F.expr("left(text, length(text) div 2)"), F.lit("zz")))
    return table("documents").select("doc_id", text.common_prefix_length(pair).alias("n"))


@query("hotword_normalise", """WITH w AS (SELECT p_partkey, lower(trim(w)) AS w, i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) WHERE trim(w) <> ''),
 f AS (SELECT p_partkey, w, min(i) AS i FROM w GROUP BY ALL) SELECT p_partkey, string_agg(w, '|' ORDER BY i) AS words, count(*) AS n FROM f GROUP BY p_partkey""")
def _(view, table):
    words = text.normalise_hotwords(F.split("p_name", " "))
    return table("part").select("p_partkey", F.lower(F.array_join(words, "|")).alias("words"), F.size(words).alias("n"))


@query("jsonl_protocol", r"""SELECT event_id, CASE WHEN k IS NULL THEN 'missing' WHEN k % 10 = 0 THEN 'version' ELSE 'ok' END AS verdict, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(view, table):
    k = F.from_json("props", "k long")["k"]
    return table("events").select("event_id", F.when(k.isNull(), "missing").when(k % 10 == 0, "version").otherwise("ok").alias("verdict"), k.alias("k"))


@query("address_codec", """SELECT c_custkey, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, n FROM (SELECT c_custkey, c_custkey % 16384 + 1 AS n FROM customer)""")
def _(view, table):
    n = F.col("c_custkey") % 16384 + 1
    return table("customer").select("c_custkey", a1.letters(n).alias("letters")).withColumn("n", a1.number(F.col("letters")))
