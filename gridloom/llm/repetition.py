"""Quality rules: how much of a text lies in repeated word n-grams and lines.

Each text is hashed once; the hashes of n-word windows follow from prefix sums,
for several n, in numpy. A word is covered if a window that holds it is a second
or later occurrence. Coverage is counted in characters of words, so overlaps
count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import code_points, free_name, window_hashes, word_hashes

#: Most characters in repeated n-grams, as a share of the characters of words.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The same for lines that repeat an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_is_symbol = np.zeros(128, bool)
_is_symbol[[ord(c) for c in SYMBOLS]] = True

MEASURES = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("dup_line_chars", T.LongType(), False)]
    + [T.StructField(f"dup_{n}gram_chars", T.LongType(), False) for n in NGRAM_LIMITS]
)


def repeated(hashes: np.ndarray, first_too: bool) -> np.ndarray:
    """Which windows are found twice or more; the first occurrence counts if first_too."""
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = hashes[order][1:] == hashes[order][:-1]
    found = np.zeros(len(hashes), bool)
    found[order] = same[:-1] | (same[1:] if first_too else False)
    return found


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a marked window of n words."""
    edge = np.zeros(len(windows) + n, np.int32)
    edge[: len(windows)] += windows
    edge[n:] -= windows
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of MEASURES for one text; null counts as empty."""
    points = code_points(text or "")
    words, starts, ends = word_hashes(points)
    if not len(words):
        low = points[points < 128]
        return (0, 0, int(_is_symbol[low].sum()), 0, 0, 0, *[0] * len(NGRAM_LIMITS))
    lengths = ends - starts
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    at = 0
    edges = np.append(starts, len(points) + 1)
    for line in text.split("\n"):
        stop = at + len(line)
        if line in seen:
            lo, hi = np.searchsorted(edges, (at, stop))
            if hi > lo:
                dup_lines += 1
                dup_line_chars += int(lengths[lo:hi].sum())
        else:
            seen.add(line)
        at = stop + 1
    repeat_words = int(covered(repeated(window_hashes(words, 3), True), 3).sum()) if len(words) >= 3 else 0
    grams = []
    for n in NGRAM_LIMITS:
        if grams and not grams[-1]:  # no shorter window repeats, so no longer one does
            grams.append(0)
            continue
        hashes = window_hashes(words, n)
        grams.append(int(lengths[covered(repeated(hashes, False), n)].sum()) if len(hashes) else 0)
    symbols = int(_is_symbol[points[points < 128]].sum())
    return (len(words), int(lengths.sum()), symbols, dup_lines, repeat_words, dup_line_chars, *grams)


def _measure_batches(column: str, out: str):
    kind = pa.struct([pa.field(f.name, pa.int64(), False) for f in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [measure(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
                fields = [pa.array(c, pa.int64()) for c in zip(*rows)]
                struct = pa.StructArray.from_arrays(fields, fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, out])

    return run


def repetition_measures(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """docs with a struct of MEASURES under the name `out`. A column of that name is replaced.

    Null and empty texts have all counts 0. Each row is measured alone, so
    repeated rows and ids need no care, and an empty table stays empty.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, MEASURES)])
    return docs.mapInArrow(_measure_batches(text, out), schema)


def base_failed(m: F.Column) -> F.Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: F.Column) -> F.Column:
    """True where neither lines nor n-grams of any length pass their limit."""
    ok = m["dup_line_chars"] <= LINE_LIMIT * m["word_chars"]
    for n, limit in NGRAM_LIMITS.items():
        ok = ok & (m[f"dup_{n}gram_chars"] <= limit * m["word_chars"])
    return ok


def quality_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept as columns; columns of these names are replaced."""
    own = [f.name for f in MEASURES] + ["base_failed", "kept"]
    taken = {c.lower() for c in own}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken and c != text])
    m = free_name(docs, "measures")
    rows = repetition_measures(docs, text, m).withColumn("base_failed", base_failed(F.col(m)))
    return rows.select(*docs.columns, f"{m}.*", "base_failed", (~F.col("base_failed") & verdict(F.col(m))).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns only."""
    m = free_name(docs, "measures")
    rows = repetition_measures(docs, text, m)
    return rows.where(~base_failed(F.col(m)) & verdict(F.col(m))).drop(m)
