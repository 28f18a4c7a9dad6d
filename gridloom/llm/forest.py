"""Approximate nearest neighbours by a forest of hash strings.

Each tree hashes a vector to a long string of bits (signs of random projections)
and keeps the strings sorted. A query descends to the entries with the longest
prefix of its own string in every tree, then ascends in all trees at once, one bit
at a time, until the entries met are enough. What was met is scored exactly.
Rows are dealt evenly over shards by a hash of their id; a shard of rows and a
block of queries meet in one task, and the best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Length of a hash string.
BITS = 48
#: Distinct rows of a shard that a query meets at least, or all if there are fewer.
LEAST_MET = 1_024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, vectors in double precision."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; their largest component goes to 1 first, so squares don't overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def shrunk(vectors: np.ndarray) -> np.ndarray:
    """The vectors by one common factor, so that the longest has length 1."""
    vectors = vectors / np.abs(vectors).max()
    return vectors / np.sqrt((vectors * vectors).sum(axis=1).max())


def lift(short: np.ndarray) -> np.ndarray:
    """One more component that makes each length 1, so that the largest inner product is the smallest angle."""
    return np.hstack([short, np.sqrt(np.maximum(0.0, 1.0 - (short * short).sum(axis=1)))[:, None]])


def hash_strings(lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """trees x rows: BITS signs as one integer, first bit highest."""
    trees = planes.shape[1] // BITS
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    out = np.empty((trees, len(lifted)), np.int64)
    for t in range(trees):
        out[t] = (lifted @ planes[:, t * BITS : (t + 1) * BITS] > 0) @ weights
    return out


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int, share: float, seed: int) -> Iterator[tuple]:
    """(query_id, id, score) of the k best rows that the forest of one shard meets for each query.

    Equal rows are one entry of the trees, so many copies don't crowd out others.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    entries, entry_of = np.unique(rows, axis=0, return_inverse=True)
    by_entry = np.argsort(entry_of.ravel(), kind="stable")
    starts = np.searchsorted(entry_of.ravel()[by_entry], np.arange(len(entries) + 1))
    planes = np.random.default_rng(seed).normal(size=(rows.shape[1] + 1, trees * BITS))
    short, directions = shrunk(entries), unit(queries)
    strings = hash_strings(lift(short), planes)
    places = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
    ordered = np.take_along_axis(strings, places, axis=1)
    wanted = hash_strings(np.hstack([directions, np.zeros((len(queries), 1))]), planes)
    enough = max(LEAST_MET, int(share * len(entries)))

    def ranges(q: int | slice, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share a prefix of this depth with the query stand in each tree."""
        cut = BITS - depth
        prefix = wanted[:, q] >> cut
        low, high = np.empty_like(prefix), np.empty_like(prefix)
        for t in range(trees):
            low[t] = np.searchsorted(ordered[t], prefix[t] << cut, "left")
            high[t] = np.searchsorted(ordered[t], (prefix[t] + 1) << cut, "left")
        return low, high

    # Descend: the deepest level that could hold enough; entries met in several trees count once below.
    need = min(enough, len(entries))
    depths = np.zeros(len(queries), np.int64)
    low = np.zeros((trees, len(queries)), np.int64)
    high = np.full((trees, len(queries)), len(entries))
    for depth in range(1, BITS + 1):
        lo, hi = ranges(slice(None), depth)
        deep = (hi - lo).sum(axis=0) >= need
        if not deep.any():
            break
        depths[deep], low[:, deep], high[:, deep] = depth, lo[:, deep], hi[:, deep]
    met = np.zeros(len(entries), bool)
    # First scores in single precision, of vectors of length 1 at most; twice the bound of their rounding errors is let through.
    coarse, coarse_queries = short.astype(np.float32), directions.astype(np.float32)
    slack = 4 * (rows.shape[1] + 4) * float(np.finfo(np.float32).eps)
    for q in range(len(queries)):
        lo, hi = low[:, q], high[:, q]
        for depth in range(depths[q], -1, -1):  # ascend in all trees at once
            if depth < depths[q]:
                lo, hi = ranges(q, depth)
            if not depth:
                found = np.arange(len(entries))
                break
            met[np.concatenate([row[i:j] for row, i, j in zip(places, lo.tolist(), hi.tolist())])] = True
            found = np.flatnonzero(met)
            met[found] = False
            if len(found) >= need:
                break
        if len(found) > k + 1:
            rough = coarse.take(found, axis=0) @ coarse_queries[q]
            edge = -np.partition(-rough, k)[k]  # one more than k: the query's own row may be among them
            found = found[rough >= edge - slack]
        scores = (entries[found] * queries[q]).sum(axis=1)  # the same sum for equal rows, wherever they are
        for entry, value in zip(found, scores):
            held = ids[by_entry[starts[entry] : starts[entry + 1]]]
            held = held[held != query_ids[q]][:k]
            for one in held:
                yield int(query_ids[q]), int(one), float(value)


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 160, share: float = 0.3, shard_rows: int = 8_192, query_rows: int = 16_384, seed: int = 11) -> DataFrame:
    """(query_id, rank, <key>, score): up to k rows with the largest inner product for each query.

    vectors and queries have key and vector. A query never gets rows with its own
    key, and meets rows of its own width only. Rows and queries whose vector is null
    or zero, or holds a null or non-finite component, take no part; nor do null keys.
    Ties go to the smaller key. A repeated key in queries counts once (its smallest
    vector); in vectors, each row counts. share is the part of a shard's distinct
    rows that a query meets at least, with a floor of LEAST_MET. Without rows or
    queries the result is empty.
    """
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    rows = usable(vectors, key, vector)
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    width = F.size("v").alias("width")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    left = rows.select("id", "v", width, shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("id", "v", width, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        found = search_shard(a["id"].to_numpy(), np.stack(a["v"]), b["id"].to_numpy(), np.stack(b["v"]), k, trees, share, seed)
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    met = left.groupBy("shard", "block", "width").cogroup(right.groupBy("shard", "block", "width")).applyInPandas(meet, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
