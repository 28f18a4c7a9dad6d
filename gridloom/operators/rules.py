"""Rules over relations. Each gives rows of diagnostics; none raises on bad data.

A diagnostic has rule, code, severity, value and n (how many rows it stands for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import is_valid_regex, strip


def present(value: Column) -> Column:
    return value.isNotNull() & (strip(value.cast("string")) != "")


def _diagnostics(rows: DataFrame, rule: str, code: str, severity: str, value: Column) -> DataFrame:
    return rows.select(value.cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), "value", "n")


def required(rows: DataFrame, field: str, rule: str = "required", severity: str = "error") -> DataFrame:
    """One row if the field is absent, has no values, or has a blank one."""
    if field not in rows.columns:
        facts = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("blank"))
    else:
        facts = rows.agg(F.count("*").alias("n"), F.count_if(~present(F.col(field))).alias("blank"))
    return facts.where((F.col("n") == 0) | (F.col("blank") > 0)).select(F.lit(rule).alias("rule"), F.lit("business.required").alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("value"), F.col("blank").alias("n"))


def regex(rows: DataFrame, field: str, pattern: str, rule: str = "regex", severity: str = "error") -> DataFrame:
    """Present values that the case-sensitive pattern isn't found in; an invalid pattern is itself the diagnostic."""
    if not is_valid_regex(pattern):
        return rows.sparkSession.range(1).select(F.lit(rule).alias("rule"), F.lit("business.regex-invalid").alias("code"), F.lit(severity).alias("severity"), F.lit(pattern).alias("value"), F.lit(1).cast("long").alias("n"))
    value = F.col(field).cast("string")
    return _diagnostics(rows.where(present(F.col(field)) & ~value.rlike(pattern)), rule, "business.regex", severity, value)


def enum(rows: DataFrame, field: str, allowed: list, rule: str = "enum", severity: str = "error") -> DataFrame:
    """Present values that aren't allowed; compared as typed values."""
    return _diagnostics(rows.where(present(F.col(field)) & ~F.col(field).isin(*allowed)), rule, "business.enum", severity, F.col(field))


def unique(rows: DataFrame, field: str, rule: str = "unique", severity: str = "error") -> DataFrame:
    """Present values that occur more than once, compared as text."""
    return _diagnostics(rows.where(present(F.col(field))), rule, "business.unique", severity, F.col(field)).where(F.col("n") > 1)


def reference(rows: DataFrame, field: str, target: DataFrame, target_field: str, rule: str = "reference", severity: str = "error") -> DataFrame:
    """Present values without an equal value in the target."""
    known = target.select(F.col(target_field).alias(field)).where(F.col(field).isNotNull()).distinct()
    return _diagnostics(rows.where(present(F.col(field))).join(known, field, "left_anti"), rule, "business.reference", severity, F.col(field))


def missing_parts(found: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Required sheets or regions (key columns and required) that a document lacks: errors if required, else warnings."""
    gone = wanted.join(found.select(*key).distinct(), key, "left_anti")
    return gone.select(*key, F.when(F.col("required"), "error").otherwise("warning").alias("severity"))


def summary(diagnostics: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, infos, valid): valid without errors and, if strict, without warnings."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0))
    out = diagnostics.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    bad = (F.col("errors") > 0) | ((F.col("warnings") > 0) if strict else F.lit(False))
    return out.withColumn("valid", ~bad)


def compare_sheets(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """(keys, side, only_left, only_right, similar) of workbooks given as (keys, header) rows.

    keys is the sheet, or what names a pair of workbooks and the sheet.
    """
    own = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set("header")).alias(name))
    none = F.array().cast("array<string>")
    rows = own(left, "l").join(own(right, "r"), list(keys), "full_outer").withColumn("side", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("shared"))
    missing = lambda a, b: F.array_except(F.coalesce(a, none), F.coalesce(b, none))
    rows = rows.withColumns({"only_left": missing("l", "r"), "only_right": missing("r", "l")})
    same = (F.size("only_left") == 0) & (F.size("only_right") == 0) & (F.col("side") == "shared")
    return rows.select(*keys, "side", F.array_join("only_left", "|").alias("only_left"), F.array_join("only_right", "|").alias("only_right"), same.alias("similar"))
