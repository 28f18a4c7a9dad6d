"""Relative paths, file names and URIs as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that no file name may have (fixed values); control characters are refused too.
FORBIDDEN = '\\/:*?"<>|'
_FORBIDDEN_NAME = r'[\\/:*?"<>|\x00-\x1f]'
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def normal_path(path: Column) -> Column:
    """A relative path with `/` only, without empty parts, `.` and the parts that `..` takes back; null if it leaves its folder.

    Absolute paths, drive letters and schemes are no relative paths: null, as for an empty one.
    """
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    nothing = F.array().cast("array<string>")
    left = F.struct(nothing.alias("kept"), F.lit(False).alias("out"))

    def step(s: Column, p: Column) -> Column:
        up, none = p == "..", F.size(s["kept"]) == 0
        kept = F.when(up & none, s["kept"]).when(up, F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).otherwise(F.concat(s["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), (s["out"] | (up & none)).alias("out"))

    walked = F.aggregate(parts, left, step)
    refused = slashed.startswith("/") | slashed.rlike(_SCHEME) | walked["out"] | (F.size(walked["kept"]) == 0)
    return F.when(~F.coalesce(refused, F.lit(True)), F.array_join(walked["kept"], "/"))


def path_problem(path: Column) -> Column:
    """Why a path is not one below its folder: empty, absolute, scheme or outside; null if it is."""
    slashed = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return (
        F.when(F.trim(slashed) == "", "empty").when(slashed.startswith("/"), "absolute").when(slashed.rlike(_SCHEME), "scheme")
        .when(normal_path(path).isNull(), "outside")
    )


def is_file_name(name: Column) -> Column:
    """Whether a text may be a file's name as it stands: one part, no forbidden character, no `..`, not blank."""
    return F.coalesce((F.trim(name) != "") & ~name.rlike(_FORBIDDEN_NAME) & ~name.contains(".."), F.lit(False))


def percent(part: Column) -> Column:
    """One part of a path in percent-encoding: letters, digits and `_.-~` stay, other bytes of its UTF-8 are escaped."""
    encoded = F.url_encode(part)  # as forms do: a blank is +, * stays, ~ is escaped
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def uri_path(path: Column) -> Column:
    """A path as a relative URI: `/` between percent-encoded parts, empty parts left out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, percent), "/")


def relative_to(path: Column, folder: Column) -> Column:
    """An absolute path as seen from an absolute folder, with `..` where it must climb."""
    a, b = (F.filter(F.split(x, "/"), lambda p: (p != "") & (p != ".")) for x in (path, folder))
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), F.lit(0), lambda n, i: F.when((n == i) & F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)), n + 1).otherwise(n))
    down = F.slice(a, same + 1, F.greatest(F.size(a) - same, F.lit(0)))
    whole = F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), down)
    return F.when(F.size(whole) == 0, ".").otherwise(F.array_join(whole, "/"))


def asset_uri(uri: Column, folder: Column) -> Column:
    """An asset's URI in a document of a folder: other schemes than file stay, absolute paths become relative, relative ones stay."""
    path = F.regexp_replace(uri, r"^file://[^/]*", "")
    other = uri.contains("://") & ~uri.startswith("file://")
    return F.when(other, uri).when(path.startswith("/"), relative_to(path, folder)).otherwise(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
