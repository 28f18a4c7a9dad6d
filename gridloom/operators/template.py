"""Templates: scoring, locating and extracting regions, claiming assets.

A template is a small declared program. Its rows are built by the driver from one
parsed file, so their number doesn't hang on the data, and they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.a1 import letters
from gridloom.functions.text import matches, strip
from gridloom.operators.grid import SHEET, bounds, has_text

SHEET_WEIGHT, PRINT_WEIGHT = 0.35, 0.65
MIN_SCORE = 0.7


@dataclass(frozen=True)
class Fingerprint:
    cells: dict[tuple[int, int], str] = field(default_factory=dict)
    required_text: tuple[str, ...] = ()
    weight: float = 1.0
    sheet_pattern: str | None = None


@dataclass(frozen=True)
class Region:
    region_id: str
    kind: str = "table"
    order: int = 0
    anchor_text: str | None = None
    anchor_pattern: str | None = None
    end_text: str | None = None
    range: tuple[int, int, int, int] | None = None
    row_offset: int = 0
    col_offset: int = 0
    height: int | None = None
    width: int | None = None
    repeat: bool = False
    header_rows: int = 1
    ignore: bool = False
    end_pattern: str | None = None
    title: str | None = None
    required: bool = False
    stop_after: int = 0
    shrink: bool = False
    trim: bool | None = None
    key_col: int = 1
    value_col: int = 2
    keys: tuple[tuple[str, str], ...] = ()
    columns: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Template:
    template_id: str
    version: str = "1"
    sheet_patterns: tuple[str, ...] = ()
    fingerprints: tuple[Fingerprint, ...] = ()
    regions: tuple[Region, ...] = ()
    min_score: float = MIN_SCORE


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def score(cells: DataFrame, template: Template) -> DataFrame:
    """(doc, template_id, version, score): 0 to 1, to six places.

    0.35 for the share of sheet patterns that a sheet matches, 0.65 for the weighted
    mean of the fingerprints, each the best over the sheets of passed checks to
    checks. Where the template declares only one of both, that counts alone.
    """
    texts = cells.select(*SHEET, "row", "col", strip(F.coalesce("display", F.lit(""))).alias("t"))
    checks = []
    for i, p in enumerate(template.fingerprints):
        here = F.lit(True) if p.sheet_pattern is None else matches(F.col("sheet"), p.sheet_pattern)
        for (row, col), text in p.cells.items():
            checks.append((i, here & F.bool_or((F.col("row") == row) & (F.col("col") == col) & (F.col("t") == text))))
        for text in p.required_text:
            checks.append((i, here & F.bool_or(F.lower("t").contains(text.lower()))))
    sheets = texts.groupBy(*SHEET).agg(F.lit(1).alias("one"), *[c.cast("int").alias(f"c{k}") for k, (_, c) in enumerate(checks)])
    best, weights = [], []
    for i, p in enumerate(template.fingerprints):
        own = [F.col(f"c{k}") for k, (j, _) in enumerate(checks) if j == i]
        passed = sum(own[1:], own[0]) / len(own) if own else F.lit(0.0)
        best.append(F.max(passed).alias(f"f{i}"))
        weights.append(p.weight)
    named = [F.bool_or(matches(F.col("sheet"), p)).cast("int").alias(f"s{i}") for i, p in enumerate(template.sheet_patterns)]
    docs = sheets.groupBy("doc").agg(F.count("*").alias("n"), *best, *named)
    prints = sum((F.col(f"f{i}") * w for i, w in enumerate(weights)), F.lit(0.0)) / sum(weights) if sum(weights) else None
    names = sum((F.col(f"s{i}") for i in range(len(named))), F.lit(0)) / len(named) if named else None
    both = F.lit(0.0) if prints is None and names is None else names if prints is None else prints if names is None else names * SHEET_WEIGHT + prints * PRINT_WEIGHT
    return docs.select("doc", F.lit(template.template_id).alias("template_id"), F.lit(template.version).alias("version"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), both)), 6).alias("score"))


def match(cells: DataFrame, templates: list[Template], min_score: float | None = None) -> DataFrame:
    """(doc, template_id, version, score, place, accepted): all candidates, best first; ties by id and version."""
    limits = {t.template_id: t.min_score if min_score is None else min_score for t in templates}
    rows = score(cells, templates[0])
    for t in templates[1:]:
        rows = rows.unionByName(score(cells, t))
    limit = F.lit(1.0)
    for k, v in limits.items():
        limit = F.when(F.col("template_id") == k, v).otherwise(limit)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "template_id", "version"))
    ok = F.col("score") >= limit
    rows = rows.withColumn("place", place).withColumn("ok", ok)
    first = F.min(F.when(F.col("ok"), F.col("place"))).over(Window.partitionBy("doc"))
    return rows.withColumn("accepted", F.col("ok") & (F.col("place") == first)).drop("ok")


def anchors(cells: DataFrame, text: str | None, pattern: str | None) -> DataFrame:
    """Cells whose stripped text is the anchor's, or matches its pattern."""
    t = strip(F.coalesce("display", F.lit("")))
    return cells.where(_any(([t == text] if text else []) + ([matches(t, pattern)] if pattern else []))).select(*SHEET, "row", "col")


def locate(cells: DataFrame, region: Region) -> DataFrame:
    """(doc, sheet, region_id, n, r0, c0, r1, c1): where the region stands; n counts repeats from 1.

    An anchored region ends above its end anchor, above the next repeat, after its
    height, or with the sheet, in the order height, end, repeat, sheet.
    """
    if region.range:
        r0, c0, r1, c1 = region.range
        return cells.select(*SHEET).distinct().select(*SHEET, F.lit(region.region_id).alias("region_id"), F.lit(1).alias("n"), F.lit(r0).alias("r0"), F.lit(c0).alias("c0"), F.lit(r1).alias("r1"), F.lit(c1).alias("c1"))
    found = anchors(cells, region.anchor_text, region.anchor_pattern)
    order = Window.partitionBy(*SHEET).orderBy("row", "col")
    found = found.withColumn("n", F.row_number().over(order))
    if region.repeat:
        found = found.withColumn("next", F.lead("row").over(order))
    else:
        found = found.where(F.col("n") == 1).withColumn("next", F.lit(None).cast("int"))
    box = bounds(cells).select(*SHEET, F.col("r0").alias("s_r0"), F.col("c0").alias("s_c0"), F.col("r1").alias("s_r1"), F.col("c1").alias("s_c1"))
    rows = found.join(box, SHEET).withColumn("r0", F.greatest(F.col("s_r0"), F.col("row") + region.row_offset)).withColumn("c0", F.greatest(F.col("s_c0"), F.col("col") + region.col_offset))
    end = F.lit(None).cast("int")
    if region.end_text:
        ends = anchors(cells, region.end_text, None).select(*SHEET, F.col("row").alias("e"))
        inside = rows.join(ends, SHEET).where((F.col("e") > F.col("r0")) & (F.col("next").isNull() | (F.col("e") < F.col("next"))))
        rows = rows.join(inside.groupBy(*SHEET, "n").agg(F.min("e").alias("e")), [*SHEET, "n"], "left")
        end = F.col("e") - 1
    height = F.lit(None).cast("int") if region.height is None else F.col("r0") + region.height - 1
    r1 = F.coalesce(height, end, F.col("next") - 1, F.greatest("r0", "s_r1"))
    c1 = F.greatest("c0", "s_c1") if region.width is None else F.col("c0") + region.width - 1
    return rows.select(*SHEET, F.lit(region.region_id).alias("region_id"), "n", "r0", "c0", F.greatest(r1, F.col("r0")).alias("r1"), F.greatest(c1, F.col("c0")).alias("c1"))


def column_semantics(labels: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """(doc, sheet, col, semantic): what each column means, each meaning once per sheet.

    labels has doc, sheet, col, label. A key of the mapping is the number of the
    column in the sheet's table, its letters, its label, or else a pattern; in this
    order of precedence, patterns in the order declared.
    """
    exact = dict(mapping)
    index = F.row_number().over(Window.partitionBy(*SHEET).orderBy("col"))
    rows = labels.withColumn("i", index.cast("string")).withColumn("l", letters(F.col("col")))
    table = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    hits = [table[F.col(c)] for c in ("i", "l", "label")] + [F.when(matches(F.col("label"), k), F.lit(v)) for k, v in mapping]
    rows = rows.withColumn("semantic", F.coalesce(*hits)).where(F.col("semantic").isNotNull())
    place = F.row_number().over(Window.partitionBy(*SHEET, "semantic").orderBy("col"))
    return rows.withColumn("place", place).where(F.col("place") == 1).select(*SHEET, "col", "semantic")


def key_semantics(pairs: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """pairs (doc, sheet, ord, key, value) under business names: exact, else first pattern, else the key; the last value wins."""
    table = F.create_map(*[F.lit(x) for pair in mapping for x in pair])
    name = F.coalesce(table[F.col("key")], *[F.when(matches(F.col("key"), k), F.lit(v)) for k, v in mapping], F.col("key"))
    rows = pairs.where(strip(F.col("key")) != "").withColumn("name", name)
    return rows.groupBy(*SHEET, "name").agg(F.max_by("value", "ord").alias("value"))


def key_values(cells: DataFrame, key_col: int, value_col: int) -> DataFrame:
    """(doc, sheet, ord, key, value) of a block whose keys and values stand in two columns."""
    keys = cells.where((F.col("col") == key_col) & has_text(F.col("display"))).select(*SHEET, F.col("row").alias("ord"), strip(F.col("display")).alias("key"))
    values = cells.where(F.col("col") == value_col).select(*SHEET, F.col("row").alias("ord"), F.col("display").alias("value"))
    return keys.join(values, [*SHEET, "ord"], "left")


def claim_assets(assets: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, sheet, asset_id, region_id): the first region (by ord) that an asset's rectangle overlaps.

    Assets that overlap none go to the sheet's first layout region, if it has one.
    Regions named unrecognized* claim nothing.
    """
    own = regions.where(~F.col("region_id").startswith("unrecognized")).select(*SHEET, "region_id", "ord", "kind", *[F.col(c).alias(f"g_{c}") for c in ("r0", "c0", "r1", "c1")])
    meets = (F.col("r0") <= F.col("g_r1")) & (F.col("g_r0") <= F.col("r1")) & (F.col("c0") <= F.col("g_c1")) & (F.col("g_c0") <= F.col("c1"))
    hits = assets.join(own, SHEET).where(meets).groupBy(*SHEET, "asset_id").agg(F.min_by("region_id", F.struct("ord", "region_id")).alias("hit"))
    layout = own.where(F.col("kind") == "layout").groupBy(*SHEET).agg(F.min_by("region_id", F.struct("ord", "region_id")).alias("rest"))
    return assets.join(hits, [*SHEET, "asset_id"], "left").join(layout, SHEET, "left").select(*SHEET, "asset_id", F.coalesce("hit", "rest").alias("region_id"))


def extract(cells: DataFrame, regions: tuple[Region, ...]) -> DataFrame:
    """cells with the region that takes them: the first in order; ignored regions take cells and show nothing."""
    found = None
    for i, r in enumerate(sorted(regions, key=lambda r: (r.order, r.region_id))):
        own = locate(cells, r).withColumn("ord", F.lit(i)).withColumn("ignore", F.lit(r.ignore))
        found = own if found is None else found.unionByName(own)
    name = F.when(F.col("n") > 1, F.concat_ws("-", "region_id", F.col("n").cast("string"))).otherwise(F.col("region_id"))
    boxes = found.select(*SHEET, name.alias("region"), "ord", "n", "ignore", "r0", "c0", "r1", "c1")
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    taken = cells.select(*SHEET, "row", "col").join(boxes, SHEET).where(inside).groupBy(*SHEET, "row", "col").agg(F.min_by(F.struct("region", "ignore"), F.struct("ord", "n")).alias("x"))
    rows = cells.join(taken, [*SHEET, "row", "col"], "left")
    return rows.where(~F.coalesce("x.ignore", F.lit(False))).withColumn("region", F.coalesce("x.region", F.lit("unrecognized"))).drop("x")
