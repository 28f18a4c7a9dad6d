"""Vectors as four small codes: integer product quantisation that gives the same codes everywhere.

Distances are screened by one float32 matrix product for each block of rows. Each
score comes with an interval that holds its exact value for any order of summation;
every entry whose interval overlaps the best one is worked out again in 64-bit
integers, and ties go to the lower index.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are below this in size, so that integers fit 64 bits.
LARGEST = float(2**52)
#: Unit roundoffs of single and double precision.
SINGLE, DOUBLE = 2.0**-24, 2.0**-53
BLOCK = 4_096
MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """True for vectors that are coded: neither null nor with a component that is null, not finite or of LARGEST or more."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def cuts(width: int) -> list[slice]:
    """The parts of a vector; where four does not divide the width, the first ones are one longer."""
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(width), PARTS))])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


def _exact_limit(width: int) -> int:
    """Integers below this in size have squared distances that fit 64 bits."""
    return int((2.0**60 / max(width, 1)) ** 0.5)


def intervals(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, radius) for each point and entry: |entry|^2 / 2 - point . entry is within radius of score.

    A single-precision product of width w, with both sides rounded first, is off by at
    most g |point| |entry|, g = (w + 2) u / (1 - (w + 2) u), in any order of summation.
    """
    n = (points.shape[1] + 2) * SINGLE
    dots = (points.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    half = (book.astype(np.float64) ** 2).sum(1) / 2
    norms = np.sqrt((points.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(2 * half)[None, :]
    radius = n / (1 - n) * norms * (1 + 1e-6) + 8 * (points.shape[1] + 2) * DOUBLE * (half[None, :] + np.abs(dots))
    return half[None, :] - dots, radius


def _nearest_small(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    score, radius = intervals(points, book)
    near = ~(score - radius > (score + radius).min(1)[:, None])
    rows, columns = np.nonzero(near)
    exact = ((points[rows] - book[columns]) ** 2).sum(1)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    best = np.minimum.reduceat(exact, starts)
    at = np.flatnonzero(exact == best[rows])
    first = at[np.flatnonzero(np.diff(rows[at], prepend=-1))]
    return columns[first], best


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, ties to the lower index; integers in Python where 64 bits are too few."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit = _exact_limit(points.shape[1])
    if np.abs(points).max(initial=0) < limit and np.abs(book).max(initial=0) < limit:
        parts = [_nearest_small(points[i : i + BLOCK], book) for i in range(0, len(points), BLOCK)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    wide = book.astype(object)
    found = [min((sum(x * x for x in p - e), j) for j, e in enumerate(wide)) for p in points.astype(object)]
    return np.array([j for _, j in found], np.int64), np.array([d for d, _ in found], object)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    vectors = batch.column(batch.schema.get_field_index("vector"))
    return integers(np.asarray(vectors.flatten()).reshape(-1, width)) if width else np.zeros((len(vectors), 0), np.int64)


def _sums(books: list[np.ndarray], width: int):
    """A mapInArrow function: for each component of each entry in use, the sum over this task's rows and their number."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch, width)
            for k, cut in enumerate(cuts(width)):
                index, _ = nearest(rows[:, cut], books[k])
                small = np.abs(rows[:, cut]).max(initial=0) < 2**40
                for place in range(books[k].shape[1]):
                    added = np.zeros(len(books[k]), np.int64 if small else object)
                    np.add.at(added, index, rows[:, cut][:, place].astype(added.dtype))
                    totals[k][:, place] += added
                counts[k] += np.bincount(index, minlength=len(books[k]))
        out = [(k, e, p, Decimal(int(totals[k][e, p])), int(n)) for k, c in enumerate(counts) for e, n in enumerate(c) if n for p in range(books[k].shape[1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def _codes(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch, width)
            found = [nearest(rows[:, cut], books[k]) for k, cut in enumerate(cuts(width))]
            code = ["".join(f"{j:02x}" for j in row) for row in zip(*(index.tolist() for index, _ in found))]
            error = [min(sum(map(int, row)), MOST) for row in zip(*(distance.tolist() for _, distance in found))]
            kept = batch.drop_columns(["vector"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*kept.schema.names, "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """(codebooks, width) over vectors with vec_id and vector, all usable.

    The first entries are the parts of the 256 smallest vec_ids (all, if fewer; a null
    vec_id comes last, equal ones are ordered by vector). The driver holds the
    codebooks alone: 256 x width integers.
    """
    first = [r["vector"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()]
    width = len(first[0]) if first else 0
    start = integers(np.array(first, np.float64).reshape(len(first), width))
    books = [start[:, cut].copy() for cut in cuts(width)]
    for _ in range(rounds if first else 0):
        parts = vectors.mapInArrow(_sums(books, width), "part int, entry int, place int, total decimal(38,0), n long")
        for r in parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books, width


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row with a usable vector.

    vectors has vec_id, label and vector; further columns are not read. Rows with an
    unusable vector, see usable(), take no part, nor do rows of another width than
    that of the smallest vec_id. Repeated rows are rows of their own; an empty table
    gives an empty result, and vectors without components give code 00000000 and
    error 0. error and label_error end at the largest 64-bit integer.
    """
    rows = vectors.where(usable(F.col(vector))).select("vec_id", "label", F.col(vector).alias("vector"))
    narrow = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("width")).collect()
    rows = checkpointed(rows.where(F.size("vector") == (narrow[0]["width"] if narrow else 0)))
    books, width = train(rows, rounds)
    kinds = dict(rows.dtypes)
    coded = checkpointed(rows.mapInArrow(_codes(books, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of").withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The same in SQL; squared distances are whole doubles, so an assignment is one minimum of distance x 256 + index."""
    parts = [f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS i, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) t(part)),
b0 AS (SELECT part, i - 1 AS entry, v FROM p WHERE i <= {ENTRIES})"""]  # fmt: skip
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT i, part, CAST(min((list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v)) * {ENTRIES} + entry) AS BIGINT) AS m FROM p JOIN b{n} b USING (part) GROUP BY i, part)")
        if n < ROUNDS:
            parts.append(f"""u{n} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT part, m % {ENTRIES} AS entry, place, floor(sum(v[place]) / count(*)) AS x
 FROM (SELECT part, m, v, unnest(range(1, len(v) + 1)) AS place FROM a{n} JOIN p USING (i, part)) GROUP BY ALL) GROUP BY part, entry),
b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.v, b.v) AS v FROM b{n} b LEFT JOIN u{n} u USING (part, entry))""")
    return f"""WITH {", ".join(parts)},
s AS (SELECT i, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM b{ROUNDS})) AS codebooks_sha256 FROM k JOIN s USING (i)"""


SQL = _sql()
