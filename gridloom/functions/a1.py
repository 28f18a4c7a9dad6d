"""Cell addresses: A1 letters to numbers and back, and rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(col: Column) -> Column:
    """Letters of a 1-based column, up to three."""
    first, second, third = (col - 703) / 676, (col - 27) / 26, col - 1
    letter = lambda n: F.char(F.pmod(n.cast("int"), F.lit(26)) + 65)
    return F.concat(F.when(col > 702, letter(first)).otherwise(""), F.when(col > 26, letter(second)).otherwise(""), letter(third))


def number(text: Column) -> Column:
    """The column number of letters."""
    return F.aggregate(F.split(F.upper(text), ""), F.lit(0), lambda a, c: a * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))


def cell(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def range_name(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    return F.concat(cell(r0, c0), F.lit(":"), cell(r1, c1))


def bounds(text: Column) -> Column:
    """struct<r0, c0, r1, c1> of a cell or range, dollar signs ignored; null if it is none."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    again = lambda i, j: F.when(part(i) == "", part(j)).otherwise(part(i))
    found = F.struct(part(2).try_cast("int").alias("r0"), number(part(1)).alias("c0"), again(4, 2).try_cast("int").alias("r1"), number(again(3, 1)).alias("c1"))
    return F.when(text.rlike(pattern), found)


def overlaps(a: Column, b: Column) -> Column:
    return (a["r0"] <= b["r1"]) & (b["r0"] <= a["r1"]) & (a["c0"] <= b["c1"]) & (b["c0"] <= a["c1"])
