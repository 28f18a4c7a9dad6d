"""Queries of whole region extraction over the grids of gridloom.plans.views, with their SQL twins."""

from __future__ import annotations

from gridloom.operators import regions
from gridloom.operators.template import Region
from gridloom.plans.registry import query

SHEETS = (
    regions.Sheet("build", "^BUILD", (
        Region("title", kind="freeform", range=(1, 1, 2, 6), order=1, title="Title"),
        Region("list", anchor_text="7", end_text="3", repeat=True, stop_after=2, order=2, title="List", columns=(("1", "first"), ("mark", "marked"), ("^\\d", "number"))),
        Region("pairs", kind="key_value", range=(5, 2, 60, 3), header_rows=0, shrink=True, order=3, keys=(("7", "seven"), ("^1", "ones"))),
        Region("gone", kind="freeform", range=(40, 1, 45, 2), ignore=True, order=4),
        Region("absent", anchor_text="no such text", required=True, order=5), Region("perhaps", anchor_pattern="^nor this$", order=6),
    )),
    regions.Sheet("rest", "^(AUTO|FURN)", (Region("grid", anchor_pattern="^customer", height=30, width=4, header_rows=2, stop_after=1),)),
    regions.Sheet("none", "^NONE$"), regions.Sheet("maybe", "^NEITHER$", required=False),
)

#: g has each region with its final corners, m the cells of the regions that show any.
BOXES = """, u AS (SELECT doc, sheet, "row" AS r, CAST(col AS BIGINT) AS c, trim(display) AS t, bold FROM v_cells),
 b AS (SELECT doc, sheet, min(r) AS s0, min(c) AS k0, max(r) AS s1, max(c) AS k1, CASE WHEN sheet LIKE 'BUILD%' THEN 0 WHEN sheet LIKE 'AUTO%' OR sheet LIKE 'FURN%' THEN 1 END AS i FROM u GROUP BY doc, sheet),
 a AS (SELECT doc, sheet, r, c, s1, k1, row_number() OVER w AS n, lead(r) OVER w AS nxt FROM u JOIN b USING (doc, sheet) WHERE i = 0 AND t = '7' WINDOW w AS (PARTITION BY doc, sheet ORDER BY r, c)),
 e AS (SELECT a.doc, a.sheet, n, min(u.r) AS e FROM a JOIN u ON u.doc = a.doc AND u.sheet = a.sheet AND u.t = '3' AND u.r > a.r AND (nxt IS NULL OR u.r < nxt) GROUP BY ALL),
 f AS (SELECT doc, sheet, min(r * 100 + c) AS p FROM u JOIN b USING (doc, sheet) WHERE i = 1 AND t ILIKE 'customer%' GROUP BY ALL),
 l AS (SELECT doc, sheet, x.k, 1 AS n, x.r0, x.c0, x.r1, x.c1 FROM b, (VALUES (0, 1, 1, 2, 6), (2, 5, 2, 60, 3), (3, 40, 1, 45, 2)) AS x(k, r0, c0, r1, c1) WHERE i = 0
  UNION ALL SELECT a.doc, a.sheet, 1, n, r, c, greatest(coalesce(e - 1, nxt - 1, s1), r), greatest(k1, c) FROM a LEFT JOIN e USING (doc, sheet, n)
  UNION ALL SELECT doc, sheet, 6, 1, p // 100, p % 100, p // 100 + 29, p % 100 + 3 FROM f),
 v AS (SELECT u.*, CASE WHEN u.c = 2 AND u.r % 10 = 1 THEN nullif(o.t, '') END AS mt FROM u LEFT JOIN u o ON o.doc = u.doc AND o.sheet = u.sheet AND o.r = u.r AND o.c = 1),
 m0 AS (SELECT l.*, v.r, v.c, v.t, coalesce(nullif(v.t, ''), CASE WHEN l.c0 <= 1 THEN v.mt END) AS sh FROM l JOIN v ON v.doc = l.doc AND v.sheet = l.sheet AND v.r BETWEEN r0 AND r1 AND v.c BETWEEN c0 AND c1),
 tr AS (SELECT DISTINCT doc, sheet, k, n, r FROM m0 WHERE sh IS NOT NULL),
 sp AS (SELECT doc, sheet, k, n, r0, CASE k WHEN 1 THEN 2 ELSE 1 END AS st, unnest(generate_series(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT))) AS r FROM l WHERE k IN (1, 6)),
 bl AS (SELECT sp.*, sum((tr.r IS NULL)::INT) OVER (PARTITION BY sp.doc, sp.sheet, sp.k, sp.n ORDER BY sp.r ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, tr.r IS NULL AS one FROM sp LEFT JOIN tr USING (doc, sheet, k, n, r)),
 ct AS (SELECT doc, sheet, k, n, min(r - st) AS cut FROM bl WHERE (st = 1 AND one) OR (st = 2 AND two = 2) GROUP BY ALL),
 m1 AS (SELECT m0.* REPLACE (greatest(r0, coalesce(cut, r1)) AS r1) FROM m0 LEFT JOIN ct USING (doc, sheet, k, n) WHERE m0.r <= greatest(r0, coalesce(cut, r1))),
 m2 AS (SELECT *, min(CASE WHEN sh IS NOT NULL THEN r END) OVER w AS y0, max(CASE WHEN sh IS NOT NULL THEN r END) OVER w AS y1, min(CASE WHEN sh IS NOT NULL THEN c END) OVER w AS x0, max(CASE WHEN sh IS NOT NULL THEN c END) OVER w AS x1,
  bool_or(sh IS NOT NULL) OVER (PARTITION BY doc, sheet, k, n, c) AS kept FROM m1 WINDOW w AS (PARTITION BY doc, sheet, k, n)),
 m3 AS (SELECT * REPLACE (CASE WHEN k = 2 THEN coalesce(y0, r0) ELSE r0 END AS r0, CASE WHEN k = 2 THEN coalesce(y1, r1) ELSE r1 END AS r1, CASE WHEN k IN (1, 2, 6) THEN coalesce(x0, c0) ELSE c0 END AS c0, CASE WHEN k IN (1, 2, 6) THEN coalesce(x1, c1) ELSE c1 END AS c1) FROM m2 WHERE k NOT IN (1, 6) OR kept OR x0 IS NULL),
 m AS (SELECT * FROM m3 WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1),
 h AS (SELECT doc, sheet, k, n, any_value(r0) AS h0, any_value(c0) AS h1, any_value(r1) AS h2, any_value(c1) AS h3, count(*) AS cells FROM m GROUP BY ALL),
 g AS (SELECT doc, sheet, k, n, CASE k WHEN 0 THEN 'title' WHEN 1 THEN 'list' WHEN 2 THEN 'pairs' WHEN 3 THEN 'gone' ELSE 'grid' END || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS region,
  CASE WHEN k = 3 THEN r0 ELSE coalesce(h0, r0) END AS r0, CASE WHEN k = 3 THEN c0 ELSE coalesce(h1, c0) END AS c0, CASE WHEN k = 3 THEN r1 ELSE coalesce(h2, r1) END AS r1, CASE WHEN k = 3 THEN c1 ELSE coalesce(h3, c1) END AS c1, coalesce(cells, 0) AS cells
  FROM l LEFT JOIN h USING (doc, sheet, k, n))"""


def _held(view):
    cells = view("cells")
    boxes = regions.located(cells, SHEETS)
    return cells, boxes, regions.members(cells, view("merges"), boxes, SHEETS)


@query("template_regions", f"""{BOXES} SELECT doc, sheet, region, CASE k WHEN 0 THEN 'Title' WHEN 1 THEN 'List' || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END END AS title, CASE k WHEN 2 THEN 'key_value' WHEN 0 THEN 'freeform' WHEN 3 THEN 'freeform' ELSE 'table' END AS kind,
 CASE WHEN k IN (1, 6) THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence, k = 3 AS "ignore", CAST(r0 AS BIGINT) AS r0, CAST(c0 AS BIGINT) AS c0, CAST(r1 AS BIGINT) AS r1, CAST(c1 AS BIGINT) AS c1, cells FROM g""")
def _(view, table):
    """Each region of each sheet with its final corners and the number of its cells."""
    _, boxes, held = _held(view)
    return regions.regions(boxes, held, SHEETS).drop("k", "n")


@query("template_values", f"""{BOXES}, p AS (SELECT k.doc, k.sheet, k.r, k.t AS key, v.t AS value FROM m k LEFT JOIN m v ON v.doc = k.doc AND v.sheet = k.sheet AND v.k = 2 AND v.r = k.r AND v.c = k.c0 + 1 WHERE k.k = 2 AND k.c = k.c0 AND k.t <> '')
 SELECT doc, sheet, 'pairs' AS region, CASE WHEN key = '7' OR contains(key, '7') THEN 'seven' WHEN key LIKE '1%' THEN 'ones' ELSE key END AS name, arg_max(value, r) AS value FROM p GROUP BY ALL""")
def _(view, table):
    """The key-value pairs of the regions that have any, under their business names."""
    return regions.pairs(_held(view)[2], SHEETS).drop("k", "n")


@query("template_columns", f"""{BOXES}, d AS (SELECT doc, sheet, k, n, c, sh, min(r) AS r FROM m WHERE k IN (1, 6) AND sh IS NOT NULL AND r < r0 + CASE k WHEN 6 THEN 2 ELSE 1 END GROUP BY ALL),
 z AS (SELECT doc, sheet, k, n, c, string_agg(sh, ' / ' ORDER BY r) AS label FROM d GROUP BY ALL), w AS (SELECT g.*, unnest(generate_series(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT))) AS c FROM g WHERE k IN (1, 6) AND cells > 0),
 q AS (SELECT doc, sheet, k, n, region, c, coalesce(label, '') AS label, CASE WHEN k <> 1 THEN NULL WHEN c = c0 OR contains(label, '1') THEN 'first' WHEN contains(label, 'mark') THEN 'marked' WHEN regexp_matches(label, '^\\d') THEN 'number' END AS s FROM w LEFT JOIN z USING (doc, sheet, k, n, c))
 SELECT doc, sheet, region, c AS col, label, CASE WHEN row_number() OVER (PARTITION BY doc, sheet, k, n, s ORDER BY c) = 1 THEN s END AS semantic FROM q""")
def _(view, table):
    """The columns of each table with their labels and meanings."""
    return regions.columns(_held(view)[2], SHEETS).drop("k", "n")


@query("template_missing", f"""{BOXES} SELECT doc, sheet, 'template.region_not_found' AS code, x.s AS severity, x.name FROM b, (VALUES (0, 1, 'list', 'warning'), (0, 4, 'absent', 'error'), (0, 5, 'perhaps', 'warning'), (1, 6, 'grid', 'warning')) AS x(i, k, name, s)
 WHERE b.i = x.i AND NOT EXISTS (SELECT 1 FROM l WHERE l.doc = b.doc AND l.sheet = b.sheet AND l.k = x.k)
 UNION ALL SELECT d.doc, NULL, 'business.required_sheet', 'error', x.name FROM (SELECT DISTINCT doc FROM b) d, (VALUES ('build', '^BUILD'), ('rest', '^(AUTO|FURN)'), ('none', '^NONE$')) AS x(name, p) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = d.doc AND regexp_matches(b.sheet, x.p))""")
def _(view, table):
    """Regions that a sheet lacks and required sheets that a document lacks."""
    cells = view("cells")
    return regions.not_found(cells, regions.located(cells, SHEETS), SHEETS)


@query("template_leftover", f"""{BOXES}, o AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = u.doc AND g.sheet = u.sheet AND u.r BETWEEN g.r0 AND g.r1 AND u.c BETWEEN g.c0 AND g.c1)),
 x AS (SELECT doc, sheet, r, bool_or(bold) AS head FROM o WHERE t <> '' GROUP BY ALL), y AS (SELECT *, coalesce((head OR r - lag(r) OVER w > 1)::INT, 1) AS fresh FROM x WINDOW w AS (PARTITION BY doc, sheet ORDER BY r)),
 z AS (SELECT doc, sheet, r, sum(fresh) OVER (PARTITION BY doc, sheet ORDER BY r) AS band FROM y), s AS (SELECT doc, sheet, band, min(r) AS r0, max(r) AS r1 FROM z GROUP BY ALL),
 c1 AS (SELECT DISTINCT doc, sheet, band, c FROM o JOIN z USING (doc, sheet, r) WHERE t <> ''), c2 AS (SELECT *, c - row_number() OVER (PARTITION BY doc, sheet, band ORDER BY c) AS grp FROM c1),
 c3 AS (SELECT doc, sheet, band, min(c) AS c0, max(c) AS c1 FROM c2 GROUP BY doc, sheet, band, grp), k AS (SELECT *, row_number() OVER (PARTITION BY doc, sheet ORDER BY band, c0) AS id FROM c3 JOIN s USING (doc, sheet, band)),
 j AS (SELECT o.doc, o.sheet, o.r, o.c, k.id, k.r0, k.c0, k.r1, k.c1 FROM o LEFT JOIN k ON k.doc = o.doc AND k.sheet = o.sheet AND o.r BETWEEN k.r0 AND k.r1 AND o.c BETWEEN k.c0 AND k.c1)
 SELECT doc, sheet, CASE WHEN i IS NULL THEN 'freeform-' ELSE 'unrecognized-' END || coalesce(CAST(id AS VARCHAR), 'grid-residual') AS region, CAST(min(coalesce(r0, r)) AS BIGINT) AS r0, min(coalesce(j.c0, c)) AS c0, CAST(max(coalesce(r1, r)) AS BIGINT) AS r1, max(coalesce(j.c1, c)) AS c1, count(*) AS cells FROM j JOIN b USING (doc, sheet) GROUP BY doc, sheet, id, i""")
def _(view, table):
    """What no region holds, in blocks of text."""
    cells, boxes, held = _held(view)
    return regions.leftover(cells, regions.regions(boxes, held, SHEETS), SHEETS)
