"""Rules over documents: fields are found by path, rules have a scope, a severity and a message of their own.

All rules of all documents are resolved by joins: a path's sheet is an alias of the
template or an id or a name, case ignored; its region and its field follow. Values
come from a region's pairs or from a table's columns of that meaning. Broken values
are rows, one for each distinct value, never lists.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.a1 import letters
from gridloom.functions.text import is_valid_regex, matches_strict, strip
from gridloom.sources.documents import Parts, stringify

KINDS = ("required", "regex", "enum", "unique", "reference")
SEVERITIES = ("info", "warning", "error")
DIAGNOSTIC = ["doc", "rule_id", "code", "severity", "message", "sheet", "region_id", "field", "value", "n"]


@dataclass(frozen=True)
class Rule:
    """field is a path sheet.region.field, or a bare name in the scope of a region."""

    rule_id: str
    kind: str
    field: str = ""
    severity: str = "error"
    message: str | None = None
    options: dict = dataclasses.field(default_factory=dict)


@dataclass(frozen=True)
class RegionRules:
    region_id: str
    required: bool = False
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class SheetRules:
    """The first sheet whose name has the pattern, case ignored, is known as sheet_id in paths."""

    sheet_id: str
    pattern: str
    required: bool = True
    regions: tuple[RegionRules, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    sheets: tuple[SheetRules, ...] = ()
    rules: tuple[Rule, ...] = ()


def field_values(parts: Parts) -> DataFrame:
    """(doc, idx, ord, field, value): the values of each field of each region; a field without any has one row with a null value and empty true."""
    pairs = F.map_entries(F.try_variant_get("values", "$", "map<string,variant>"))
    own = parts.regions.select("doc", "idx", "ord", F.explode(pairs).alias("p")).select("doc", "idx", "ord", F.col("p.key").alias("field"), F.col("p.value").alias("value"), F.lit(False).alias("empty"))
    columns = parts.tables.select("doc", "idx", "ord", "n", "header_rows", F.explode("column_semantics").alias("letter", "field"))
    first = parts.cells.groupBy("doc", "idx", "ord", "n").agg(F.min("row").alias("top"))
    columns = columns.join(first, ["doc", "idx", "ord", "n"], "left").withColumn("data", F.coalesce("top", F.lit(1)) + F.col("header_rows"))
    cells = parts.cells.select("doc", "idx", "ord", "n", "row", letters(F.col("col")).alias("letter"), F.coalesce("raw", F.when(F.col("display").isNotNull(), F.parse_json(F.substring(F.to_json(F.array("display")), F.lit(2), F.length(F.to_json(F.array("display"))) - 2)))).alias("value"))
    found = columns.join(cells, ["doc", "idx", "ord", "n", "letter"], "left").where(F.col("row").isNull() | (F.col("row") >= F.col("data")))
    # A column whose cells all lie above its data is there, without values.
    seen = columns.select("doc", "idx", "ord", "field").distinct()
    values = found.where(F.col("row").isNotNull()).select("doc", "idx", "ord", "field", "value", F.lit(False).alias("empty"))
    bare = seen.join(values.select("doc", "idx", "ord", "field").distinct(), ["doc", "idx", "ord", "field"], "left_anti").select("doc", "idx", "ord", "field", F.lit(None).cast("variant").alias("value"), F.lit(True).alias("empty"))
    tables = values.unionByName(bare)
    return own.unionByName(tables.join(own.select("doc", "idx", "ord", "field"), ["doc", "idx", "ord", "field"], "left_anti"))


def _aliases(parts: Parts, rules: RuleSet) -> DataFrame:
    """(doc, sheet_id, idx): the sheet that each alias stands for in each document."""
    known = F.array(*[F.struct(F.lit(s.sheet_id).alias("alias"), F.lit(s.pattern).alias("pattern")) for s in rules.sheets]) if rules.sheets else F.array().cast("array<struct<alias:string,pattern:string>>")
    good = [s for s in rules.sheets if is_valid_regex(s.pattern)]
    hit = F.lit(False)
    for s in good:
        hit = hit | (F.col("k.alias") == s.sheet_id) & F.col("name").rlike(f"(?iu){s.pattern}")
    rows = parts.sheets.select("doc", "idx", "name", F.explode(known).alias("k")).where(hit)
    return rows.groupBy("doc", F.col("k.alias").alias("alias")).agg(F.min("idx").alias("idx"))


def _flat(rules: RuleSet) -> list[tuple[Rule, str | None, str | None]]:
    """All rules with the alias and the region of their scope."""
    scoped = [(r, s.sheet_id, g.region_id) for s in rules.sheets for g in s.regions for r in g.rules]
    return scoped + [(r, None, None) for r in rules.rules]


def _path(rule_field: str, alias: str | None, region: str | None) -> tuple[str | None, str | None, str | None]:
    """(sheet, region, field) that a field names; nothing for a path of fewer than three parts."""
    if alias is not None and "." not in rule_field:
        return alias, region, rule_field
    parts = rule_field.split(".")
    return (parts[0], parts[1], ".".join(parts[2:])) if len(parts) >= 3 else (None, None, None)


def resolve(parts: Parts, paths: list[tuple[str | None, str | None, str | None]], rules: RuleSet) -> DataFrame:
    """(doc, k, idx, ord, sheet, region_id, field): where each path, by its number, leads in each document; idx or ord null where it doesn't."""
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("string").alias("token"), F.lit(r).cast("string").alias("region_id"), F.lit(f).cast("string").alias("field")) for k, (s, r, f) in enumerate(paths)])
    asked = parts.heads.select("doc", F.explode(listed).alias("p")).select("doc", "p.*")
    names = parts.sheets.select("doc", "idx", F.explode(F.array_distinct(F.array(F.lower("sheet_id"), F.lower("name")))).alias("low")).groupBy("doc", "low").agg(F.min("idx").alias("named"))
    aliases = _aliases(parts, rules).withColumnRenamed("alias", "token").withColumnRenamed("idx", "aliased")
    rows = asked.join(aliases, ["doc", "token"], "left").withColumn("low", F.lower("token")).join(names, ["doc", "low"], "left")
    rows = rows.withColumn("idx", F.coalesce("aliased", "named")).drop("aliased", "named", "low")
    regions = parts.regions.groupBy("doc", "idx", "region_id").agg(F.min("ord").alias("ord"))
    sheets = parts.sheets.select("doc", "idx", F.col("name").alias("sheet"))
    return rows.join(regions, ["doc", "idx", "region_id"], "left").join(sheets, ["doc", "idx"], "left").select("doc", "k", "token", "idx", "ord", "sheet", "region_id", "field")


def _missing(parts: Parts, rules: RuleSet) -> list[DataFrame]:
    """Rows for required sheets and regions that a document lacks."""
    out, aliases, none = [], _aliases(parts, rules), F.lit(None).cast("string")

    def told(rows: DataFrame, code: str, message: str, sheet: Column, region: Column) -> DataFrame:
        return rows.select("doc", F.lit(code).alias("rule_id"), F.lit(f"business.{code}").alias("code"), F.lit("error").alias("severity"), F.lit(message).alias("message"), sheet.alias("sheet"), region.alias("region_id"), F.lit("").alias("field"), none.alias("value"), F.lit(1).cast("long").alias("n"))

    for s in rules.sheets:
        found = aliases.where(F.col("alias") == s.sheet_id)
        if s.required:
            out.append(told(parts.heads.join(found, "doc", "left_anti"), "required_sheet", f"no sheet for {s.sheet_id}", none, none))
        for r in s.regions:
            if r.required:
                has = parts.regions.where(F.col("region_id") == r.region_id).select("doc", "idx")
                lack = found.join(has, ["doc", "idx"], "left_anti").join(parts.sheets.select("doc", "idx", "name"), ["doc", "idx"])
                out.append(told(lack, "required_region", f"no region {r.region_id}", F.col("name"), F.lit(r.region_id)))
    return out


def diagnostics(parts: Parts, rules: RuleSet) -> DataFrame:
    """DIAGNOSTIC rows of all that documents break.

    A region's rules don't apply where the region is absent, and a rule whose path
    begins with the alias of a sheet that isn't there is skipped. Null and blank
    values only break `required`. regex and enum and reference give a row for each
    distinct broken value, unique for each value that occurs again.
    """
    flat = _flat(rules)
    for rule, *_ in flat:
        if rule.kind not in KINDS:
            raise ValueError(f"no kind of rule: {rule.kind}")
    targets = [r.options.get("target") or r.options.get("target_field") or "" for r, *_ in flat]
    paths = [_path(r.field, a, g) for r, a, g in flat] + [_path(t, None, None) for t in targets]
    out = _missing(parts, rules)
    if flat:
        out += _broken(parts, rules, flat, targets, resolve(parts, paths, rules))
    if not out:
        return parts.heads.where("false").select("doc", *[F.lit(None).cast("long" if c == "n" else "string").alias(c) for c in DIAGNOSTIC[1:]])
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return whole


def _of(values: list, kind: str = "string") -> Column:
    """The value of a rule's number k."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("k"))


def _broken(parts: Parts, rules: RuleSet, flat: list[tuple[Rule, str | None, str | None]], targets: list[str], located: DataFrame) -> list[DataFrame]:
    """Rows for what a field lacks as a whole, and for its broken values; the values are read once for all rules."""
    n, known, where = len(flat), {s.sheet_id for s in rules.sheets}, ["doc", "k", "sheet", "region_id"]
    each = [r for r, *_ in flat]
    scoped = [alias is not None and "." not in r.field for r, alias, _ in flat]
    aliased = [not s and r.field.split(".")[0] in known for r, s in zip(each, scoped)]
    labels, kind = [r.field or r.rule_id for r in each], _of([r.kind for r in each])
    patterns = [r.options.get("pattern") if isinstance(r.options.get("pattern"), str) else None for r in each]
    usable = [p is not None and is_valid_regex(p) for p in patterns]
    joined = located.join(field_values(parts), ["doc", "idx", "ord", "field"], "left").withColumns({"found": F.col("empty").isNotNull(), "shown": stringify(F.col("value")), "typed": F.to_json("value")})
    joined = joined.withColumn("present", F.col("found") & ~F.col("empty") & F.col("value").isNotNull() & (strip(F.col("shown")) != ""))
    mine = joined.where((F.col("k") < n) & (~_of(scoped, "boolean") | F.col("ord").isNotNull()) & (~_of(aliased, "boolean") | F.col("idx").isNotNull()))
    target = joined.where(F.col("k") >= n).withColumn("k", F.col("k") - n)
    there = target.groupBy("doc", "k").agg(F.bool_or("found").alias("there"))
    held = target.where(F.col("found") & F.col("typed").isNotNull()).select("doc", "k", "typed", F.lit(True).alias("held")).distinct()
    none = F.lit(None).cast("string")
    told = lambda text, value=none, count=F.lit(1): F.struct(text.alias("message"), value.alias("value"), count.cast("long").alias("n"))
    label, path = _of(labels), _of(targets)
    facts = mine.groupBy(*where).agg(F.bool_or("found").alias("found"), F.count_if(~F.col("present")).alias("blank")).join(there, ["doc", "k"], "left")
    wrong = (
        F.when((kind == "required") & ~F.col("found"), told(F.concat(F.lit("no field or column "), label)))
        .when((kind == "required") & (F.col("blank") > 0), told(F.concat(F.lit("no value for "), label), count=F.col("blank")))
        .when((kind == "regex") & _of(patterns).isNull(), told(F.concat(F.lit("no pattern for "), label)))
        .when((kind == "regex") & ~_of(usable, "boolean"), told(F.concat(F.lit("invalid pattern for "), label), _of(patterns)))
        .when((kind == "reference") & ~F.coalesce("there", F.lit(False)), told(F.concat(F.lit("no target "), path), path))
    )
    whole = facts.withColumn("x", wrong).where(F.col("x").isNotNull()).select(*where, "x.*")
    bad = F.lit(False)
    for k, rule in enumerate(each):
        if rule.kind == "regex" and usable[k]:
            bad = F.when(F.col("k") == k, ~matches_strict(F.col("shown"), patterns[k])).otherwise(bad)
        elif rule.kind == "enum":
            allowed = [json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in rule.options.get("values", rule.options.get("enum", []))]
            bad = F.when(F.col("k") == k, ~F.col("typed").isin(*allowed) if allowed else F.lit(True)).otherwise(bad)
        elif rule.kind == "unique":
            bad = F.when(F.col("k") == k, F.lit(True)).otherwise(bad)
        elif rule.kind == "reference":
            bad = F.when(F.col("k") == k, F.coalesce("there", F.lit(False)) & F.col("held").isNull()).otherwise(bad)
    values = mine.where("present").join(held, ["doc", "k", "typed"], "left").join(there, ["doc", "k"], "left").where(bad)
    counted = values.groupBy(*where, F.col("shown").alias("value")).agg(F.count("*").alias("n")).where((kind != "unique") | (F.col("n") > 1))
    words = F.when(kind == "regex", F.concat(label, F.lit(" does not match"))).when(kind == "enum", F.concat(label, F.lit(" is not allowed"))).when(kind == "unique", F.concat(label, F.lit(" is not unique"))).otherwise(F.concat(label, F.lit(" is not in "), path))
    severity = _of([r.severity if r.severity in SEVERITIES else "error" for r in each])
    return [
        rows.select("doc", _of([r.rule_id for r in each]).alias("rule_id"), F.concat(F.lit("business."), kind).alias("code"), severity.alias("severity"), F.coalesce(_of([r.message for r in each]), message).alias("message"), "sheet", "region_id", _of([r.field for r in each]).alias("field"), "value", "n")
        for rows, message in ((whole, F.col("message")), (counted, words))
    ]
