"""Packing: length buckets with the least padding, and token-budget batches inside each.

Texts over the longest length become several sequences, each a span of its text's
tokens, so the histogram of all lengths has at most max_length entries at any input
size. Dynamic programming over it gives the best boundaries. Sequences are numbered
inside their bucket by counts of hashed slices and places inside a slice, so no task
holds a bucket; equal and null keys are dealt over the slices too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed, free_name, parallelism, written


def best_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Ascending upper ends of at most n_buckets buckets with the least total padding.

    lengths ascend and are distinct. best[k][j] is the least padded size of the
    first j lengths in k buckets; each bucket is padded to its longest length.
    """
    n = len(lengths)
    if not n:
        return []
    held = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    ends = np.asarray(lengths, np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(n_buckets, n)):
        row, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        row[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + (held[j] - held[:j]) * ends[j - 1]
            cut[j] = int(np.argmin(cost))
            row[j] = cost[cut[j]]
        cuts.append(cut)
        best = row
    found, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        found.append(lengths[j - 1])
        j = int(cut[j])
    return found[::-1]


def token_count(text: Column) -> Column:
    """Words and single marks, as an estimate of tokens that needs no vocabulary; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0))


def cut(docs: DataFrame, ids: str, max_length: int) -> DataFrame:
    """docs with a row (part, start, tokens, and its own ids) for each run of up to max_length ids; a null array has none.

    An array is cut before its rows are made, so a long one is copied once, not for
    each of its sequences.
    """
    held = F.coalesce(F.col(ids), F.array().cast(dict(docs.dtypes)[ids]))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(held) / max_length).cast("int") - 1))
    spans = F.transform(places, lambda i: F.struct(i.alias("part"), F.slice(held, i * max_length + 1, max_length).alias("ids")))
    spans = F.when(F.size(held) <= max_length, F.array(F.struct(F.lit(0).alias("part"), held.alias("ids")))).otherwise(spans)  # most are whole, and slices inside a lambda copy id by id
    name = free_name(docs, "span")
    rows = docs.withColumn(name, F.explode(spans)).withColumn(ids, F.col(f"{name}.ids"))
    return rows.withColumns({"part": F.col(f"{name}.part"), "start": (F.col(f"{name}.part") * max_length).cast("long"), "tokens": F.size(ids)}).drop(name)


def sequences(docs: DataFrame, length: Column, max_length: int) -> DataFrame:
    """A row (columns of docs, part, start, tokens) for each run of up to max_length tokens, from token start.

    A document without tokens is one sequence of length 0, so none is lost.
    """
    n, part = free_name(docs, "n_all"), F.col("part")
    return (
        docs.withColumn(n, length.cast("long"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(n) / max_length).cast("int") - 1))))
        .withColumn("start", (part * max_length).cast("long"))
        .withColumn("tokens", F.least(F.lit(max_length), F.col(n) - part * max_length).cast("int"))
        .drop(n)
    )


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, ids: str | None = None, n_buckets: int = 16, budget: int = 65_536, max_length: int = 8_192, slice_rows: int = 100_000) -> DataFrame:
    """(key, part, start, tokens, bucket, batch, place): every sequence of docs in one batch; with ids also its own ids.

    length is the number of tokens of a row, token_count() of its text where none is
    given; where ids names a column of token ids, that is what is cut and counted, and
    a sequence carries max_length of them at most. A sequence is the span of tokens
    from start on; without ids, batches() cuts it out.
    bucket is the padded length; a batch holds budget // bucket sequences of its
    bucket, only the last one of a bucket may hold fewer. Rows with equal or null
    keys are packed as often as they occur. place numbers the sequences of a batch
    from 0. An empty table gives no rows. Columns of docs other than the key are
    not carried, so their names cannot clash.
    """
    if ids is None:
        length = token_count(F.col("text")) if length is None else length
        rows = sequences(docs.select(F.col(key).alias("key"), length.alias("n_tokens")), F.col("n_tokens"), max_length).drop("n_tokens")
    else:
        rows = cut(docs.select(F.col(key).alias("key"), F.col(ids).alias("ids")), "ids", max_length)
    carried = [F.col("ids").alias(ids)] if ids else []
    # With ids a Parquet table: it is smaller than a checkpoint, and counting reads its narrow columns alone.
    rows = (written if ids else checkpointed)(rows.withColumn("salt", F.monotonically_increasing_id()))
    histogram = sorted((r["tokens"], r["count"]) for r in rows.groupBy("tokens").count().collect())
    boundaries = [max(1, x) for x in best_boundaries([a for a, _ in histogram], [b for _, b in histogram], n_buckets)]
    total = sum(b for _, b in histogram)
    slices = max(parallelism(docs.sparkSession), -(-total // slice_rows))
    bucket = F.lit(boundaries[-1] if boundaries else 1)
    for end in reversed(boundaries[:-1]):
        bucket = F.when(F.col("tokens") <= end, end).otherwise(bucket)
    placed = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("key", "part", "salt"), F.lit(slices)).cast("int"))
    counts = placed.groupBy("bucket", "slice").count()
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("bucket", "slice").orderBy("key", "part", "tokens", "salt")
    at = F.col("first") + F.row_number().over(inside) - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return placed.join(starts, ["bucket", "slice"]).select(
        F.col("key").alias(key), "part", "start", "tokens", "bucket", F.floor(at / size).cast("long").alias("batch"), (at % size).cast("int").alias("place"), *carried
    )


def batches(packed: DataFrame, encoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """packed with the ids of each sequence, cut from the encoded rows of its key, which must be unique and not null."""
    cut = F.slice(ids, (F.col("start") + 1).cast("int"), F.col("tokens"))
    return packed.join(encoded.select(key, ids), key).withColumn(ids, cut)


def padding(packed: DataFrame) -> DataFrame:
    """One row: tokens, padded size and their share, over all sequences."""
    return packed.agg(F.sum("tokens").alias("tokens"), F.sum("bucket").alias("padded")).withColumn("filled", F.col("tokens") / F.col("padded"))
