"""Text expressions. All are built-in column functions, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a sentence.
SENTENCE_END = "。．！？….!?"


def strip(text: Column) -> Column:
    """Without blanks at both ends, Unicode blanks and U+001C to U+001F included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def shown(display: Column, raw: Column) -> Column:
    return strip(F.coalesce(display, raw, F.lit("")))


def is_valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def matches(text: Column, pattern: str) -> Column:
    """Unanchored, case-insensitive; a pattern that isn't a valid one is looked for as text."""
    if is_valid_regex(pattern):
        return text.rlike(f"(?iu){pattern}")
    return F.lower(text).contains(pattern.lower())


def matches_strict(text: Column, pattern: str) -> Column:
    """Unanchored, case-sensitive; an invalid pattern matches nothing."""
    return text.rlike(pattern) if is_valid_regex(pattern) else F.lit(False)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def significant(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def significant_prefix(text: Column, n: Column) -> Column:
    """The shortest prefix of text with n characters that aren't blanks."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        more = s["n"] < n
        return F.struct(F.when(more, F.concat(s["out"], c)).otherwise(s["out"]).alias("out"), (s["n"] + (more & ~c.rlike(r"(?U)^\s$")).cast("int")).alias("n"))

    return F.aggregate(F.split(text, ""), start, step)["out"]


def common_prefix_length(texts: Column) -> Column:
    """Length of the longest prefix that all significant texts of an array share; one pass over their characters."""
    bare = F.transform(texts, lambda t: F.split(significant(t), ""))
    first = F.get(bare, F.lit(0))

    def shared(other: Column) -> Column:
        apart = F.array_position(F.zip_with(first, other, lambda x, y: x.eqNullSafe(y)), False).cast("int")
        return F.when(apart > 0, apart - 1).otherwise(F.size(first))

    same = F.array_min(F.transform(bare, shared))
    return F.coalesce(F.when(F.exists(texts, lambda t: significant(t) == ""), 0).otherwise(same), F.lit(0))


def ends_sentence(text: Column) -> Column:
    return text.rlike(rf"(?U)[{re.escape(SENTENCE_END)}]\s*$")


def safe_name(text: Column, replacement: str = "_") -> Column:
    """Characters that file systems refuse become the replacement."""
    return F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', replacement)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def markdown_cell(text: Column) -> Column:
    """For the business view: backslashes and pipes escaped, line breaks as tags."""
    return F.regexp_replace(_piped(text), "\r?\n", "<br>")


def markdown_plain(text: Column) -> Column:
    """For plain tables: pipes escaped, line feeds as blanks, carriage returns dropped."""
    return F.replace(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def markdown_flat(text: Column) -> Column:
    """For heuristic tables: lines stripped and joined by one blank, empty ones dropped; backslashes and pipes escaped."""
    lines = F.filter(F.transform(F.split(text, "\r\n?|\n"), strip), lambda x: x != "")
    return _piped(F.array_join(lines, " "))


def markdown_summary(text: Column) -> Column:
    """For the action table: every line break character is a blank, pipes escaped."""
    return F.replace(F.translate(text, "\r\n", "  "), F.lit("|"), F.lit("\\|"))


def _piped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label(text: Column) -> Column:
    """A label without its colon."""
    return strip(F.regexp_replace(strip(text), "[：:]+$", ""))


def strip_code_fence(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*\n?|\n?```$", ""))


def sanitised_error(body: Column) -> Column:
    """code/type/param of a JSON error, of safe characters only; null if none is there."""
    parts = [F.get_json_object(body, f"$.error.{k}") for k in ("code", "type", "param")]
    safe = [F.when(p.isNotNull(), F.concat(F.lit(f"{k}="), F.substring(F.regexp_replace(p, r"[^A-Za-z0-9_.\-]", ""), 1, 64))) for k, p in zip(("code", "type", "param"), parts)]
    return F.nullif(F.concat_ws(" ", *safe), F.lit(""))


def date_display(text: Column) -> Column:
    """Y/M/D of texts that start with an ISO date; others as they are."""
    parts = [F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("/", parts[0], *[p.try_cast("int").cast("string") for p in parts[1:]])).otherwise(text)


def normalise_hotwords(words: Column, most: int = 64, longest: int = 40, total: int = 1000) -> Column:
    """Trimmed, without blanks and repeats (case ignored), within the limits; order kept."""
    cleaned = F.filter(F.transform(words, strip), lambda w: (w != "") & (F.length(w) <= longest))
    first = F.aggregate(cleaned, F.array().cast("array<string>"), lambda a, w: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(w)), a).otherwise(F.concat(a, F.array(w))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, w: Column) -> Column:
        fits = (s["n"] + F.length(w) <= total) & (F.size(s["out"]) < most)
        return F.struct(F.when(fits, F.concat(s["out"], F.array(w))).otherwise(s["out"]).alias("out"), (s["n"] + F.when(fits, F.length(w)).otherwise(0)).alias("n"))

    return F.aggregate(first, start, step)["out"]
