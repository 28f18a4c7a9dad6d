"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-case characters. The value of
a feature is the log ratio of its (smoothed) document counts in the two classes,
times log2(1 + how often the text has it); a logistic regression is fitted over
these values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import checkpointed, code_points, free_name, held_out, powers, written

SIZES = (3, 4, 5, 6)
HASH_BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """One weight for each hash of an n-gram (2**HASH_BITS floats), and the intercept."""

    weights: np.ndarray
    intercept: float
    #: Without both classes in the training rows, every text gets this score.
    constant: float | None = None


def ngram_ids(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of a text, repeats included."""
    points = code_points((text or "").lower()).astype(np.uint64) + np.uint64(1)
    up, _ = powers(max(SIZES))
    found, sums = [], np.zeros(0, np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            break
        term = points[n - 1 :] * up[n - 1]
        sums = term if n == 1 else sums[: len(term)] + term
        if n in SIZES:
            h = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            found.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _texts(batches: Iterator[pa.RecordBatch], *columns: str, size: int = 256):
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            yield batch, *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of a sample of labelled documents outside the held-out fold.

    The sample is drawn by a hash of doc_id and expected to hold max_rows rows;
    its ids alone are broadcast, so the side's size is bounded by this parameter.
    A document with several label rows is toxic if any says so; null labels and
    null ids take no part.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    n = ids.count()
    if n > max_rows:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def _class_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): number of documents of each class that hold it."""

    def run(batches):
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for _, texts, marks in _texts(batches, "text", "label"):
            for text, mark in zip(texts, marks):
                counts[int(mark > 0), np.unique(ngram_ids(text))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for lo in range(0, len(at), 100_000):
            own = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[1, own].astype(np.int64)), pa.array(counts[0, own].astype(np.int64))], names=["feature", "toxic", "clean"])

    return rows.mapInArrow(run, "feature int, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000, smoothing: float = 300.0, strength: float = 1e-4) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold.

    max_rows bounds the sample of labelled rows at every input size. All hashed
    n-grams of the sample are features, none is left out; smoothing, the weight of
    the rate over both classes in that of each, keeps rare ones near a ratio of 1.
    Without rows of both classes, an empty table too, the model is a constant.
    """
    rows = checkpointed(training_rows(docs, labels, max_rows))
    sizes = {r["label"] > 0: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(np.zeros(1 << HASH_BITS, np.float32), 0.0, 1.0 if n_toxic else 0.0)
    share = n_toxic / (n_toxic + n_clean)
    p = (F.col("toxic") + smoothing * share) / n_toxic
    q = (F.col("clean") + smoothing * (1 - share)) / n_clean
    counts = _class_counts(rows).select("feature", F.log(p / q).cast("float").alias("ratio")).toArrow()  # one row a hash, 8 MB at most
    ratios = np.zeros(1 << HASH_BITS, np.float32)
    ratios[np.asarray(counts["feature"])] = np.asarray(counts["ratio"])
    del counts
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def vectors(batches):
        for _, texts, marks in _texts(batches, "text", "label"):
            held = [by_times(ngram_ids(t)) for t in texts]
            columns = [pa.array([x.astype(np.int32).tobytes() for x in part], pa.binary()) for part in zip(*held)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.float64())], names=["at", "times", "runs", "label"])

    prepared = written(rows.mapInArrow(vectors, "at binary, times binary, runs binary, label double"))
    start = float(np.log(share / (1 - share)))

    def solve(batches):
        weights, intercept = logistic([part for _, *part in _texts(batches, "at", "times", "runs", "label", size=64)], shared.value, start, strength)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "intercept": [intercept]})

    solved = prepared.coalesce(1).mapInArrow(solve, "weights binary, intercept double").first()
    weights, intercept = np.frombuffer(solved["weights"], np.float32), solved["intercept"]
    return ToxicityModel((weights * ratios).astype(np.float32), intercept)


def by_times(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order of how often they occur; the distinct numbers of times; how many hashes have each."""
    found, n = np.unique(ids, return_counts=True)
    order = np.argsort(n, kind="stable")
    times, runs = np.unique(n, return_counts=True)
    return found[order], times, runs


def logistic(rows: list[tuple[list[bytes], list[bytes], list[bytes], list[float]]], ratios: np.ndarray, intercept: float, strength: float, rounds: int = 30, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least mean logistic loss plus strength / 2 times the squared weights.

    rows are parts of the bounded sample (packed hashes, numbers of times and runs as of
    by_times(), labels), so one task holds them: four bytes for each hash of a row, as
    its value is its ratio times log2(1 + times). Limited-memory quasi-Newton steps over
    the unscaled values: the log-count ratios are their scale, which a standardising
    solver would take away.
    """
    size = 1 << HASH_BITS
    n = sum(len(labels) for *_, labels in rows)

    def slope_at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope, scaled = 0.0, np.zeros(size + 1), x[:-1] * ratios
        for at, times, runs, labels in rows:
            where, marks = np.frombuffer(b"".join(at), np.int32), np.array(labels)
            often = np.repeat(np.log2(1 + np.frombuffer(b"".join(times), np.int32)), np.frombuffer(b"".join(runs), np.int32))
            row = np.repeat(np.arange(len(marks)), [len(y) // 4 for y in at])
            z = np.bincount(row, often * scaled[where], minlength=len(marks)) + x[-1]
            loss += float((np.logaddexp(0, z) - marks * z).sum())
            miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - marks
            np.add.at(slope, where, often * miss[row])
            slope[-1] += miss.sum()
        slope[:-1] *= ratios
        slope /= n
        slope[:-1] += strength * x[:-1]
        return loss / n + strength / 2 * float(x[:-1] @ x[:-1]), slope

    x = np.zeros(size + 1)
    x[-1] = intercept
    loss, slope = slope_at(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for moved, turned in reversed(steps):
            shares.append(moved @ way / (moved @ turned))
            way -= shares[-1] * turned
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (moved, turned), share in zip(steps, reversed(shares)):
            way += moved * (share - turned @ way / (moved @ turned))
        length = 1.0
        while length > 1e-3:
            lower, new = slope_at(x - length * way)
            if lower <= loss - 1e-4 * length * float(slope @ way):
                break
            length /= 2
        else:
            break
        steps = [*steps, ((-length * way).astype(np.float32), (new - slope).astype(np.float32))][-memory:]
        x, slope, before, loss = x - length * way, new, loss, lower
        if before - loss < 1e-6 * before:
            break
    return x[:-1], float(x[-1])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out` from 0 to 1 (replaced if there).

    Null and empty texts have no features and get the score of the intercept.
    The weights, 4 MB at any input size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def run(batches):
        m = shared.value
        used = m.weights != 0
        for batch, texts in _texts(batches, text):
            total = np.zeros(len(texts))
            for i, t in enumerate(texts):
                ids = ngram_ids(t)
                found, times = np.unique(ids[used[ids]], return_counts=True)
                total[i] = (m.weights[found] * np.log2(1 + times)).sum(dtype=np.float64)
            scores = 1 / (1 + np.exp(-np.clip(total + m.intercept, -500, 500))) if m.constant is None else np.full(len(texts), m.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs with a score below the threshold, with their own columns only."""
    name = free_name(docs, "score")
    return score(docs, model, text, name).where(F.col(name) < threshold).drop(name)
