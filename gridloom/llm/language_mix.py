"""Languages of a text as a mixture.

Each language is a distribution over n-grams of letters; a text is a mixture of
languages. Expectation-maximisation estimates the proportions from the n-grams'
likelihoods, and of the sets of its leading languages the one with the largest
penalised likelihood is chosen, so a few words of another language do not count as
one. All texts of a block go through each step at once, as segments of one array.

The distributions are counted over all rows to learn from: n-grams are hashed to
BUCKETS, so a language is BUCKETS numbers whatever the input's size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BASE, checkpointed, code_points, free_name, mix

ORDERS = (1, 2, 3)
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: More languages than this are refused: the model is broadcast, 512 KB a language.
MOST_LANGUAGES = 256
#: So many n-grams of every language are taken from all languages' distribution.
POOLED = 2_000.0
STEPS = 12
#: One more language must raise the log likelihood by so much for each doubling of the text's n-grams.
PENALTY = 4.0
#: Code points, and n-grams times languages, that are worked on at once.
BLOCK_POINTS, BLOCK_CELLS = 1 << 18, 1 << 22
UNKNOWN = "und"

COUNT = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case where it belongs to a word (letters and their marks), else 0; and whether it is a letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    lower = np.array([ord(chr(i).lower()[0]) if k in "LM" else 0 for i, k in enumerate(kinds)], np.uint32)
    return lower, letter


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of all distinct n-grams of texts, in order of text.

    n-grams lie in one word and the blank before and after it.
    """
    lower, _ = _letters()
    points = [code_points(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in points])
    line = lower[np.concatenate([x for p in points for x in (p, np.zeros(1, np.uint32))])] if texts else np.zeros(0, np.uint32)
    keep = (line != 0) | np.append(False, line[:-1] != 0)  # one blank after each word
    line, owner = np.append(np.uint32(0), line[keep]).astype(np.uint64), np.append(0, owner[keep])
    found = []
    for n in ORDERS:
        if len(line) < n:
            continue
        h = np.full(len(line) - n + 1, np.uint64(n))
        inner = np.ones(len(h), bool)
        for j in range(n):
            part = line[j : len(line) - n + 1 + j]
            h = h * BASE + part + np.uint64(1)
            inner &= (part != 0) if 0 < j < n - 1 or n == 1 else True
        if n == 2:
            inner &= (line[:-1] != 0) | (line[1:] != 0)
        place = np.flatnonzero(inner) + (n - 1) // 2
        place += (n == 2) & (line[place] == 0)  # the blank before a word belongs to it
        found.append(owner[place].astype(np.int64) << BUCKET_BITS | (mix(h[inner]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return keys >> BUCKET_BITS, keys & (BUCKETS - 1), counts


def _blocks(sizes: list[int], most: int) -> Iterator[slice]:
    """Following slices of about most in all, one item at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) sums of a task; at most 32 languages are held before they are handed on."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], schema=COUNT)
        held.clear()

    for batch in batches:
        rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        texts, langs = [t for _, t in rows], [lang for lang, _ in rows]
        for block in _blocks([len(t) for t in texts], BLOCK_POINTS):
            owner, bucket, count = grams(texts[block])
            names, which = np.unique(np.array(langs[block], object), return_inverse=True)
            for i, lang in enumerate(names):
                if lang not in held and len(held) == 32:
                    yield from told()
                own = which[owner] == i
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(bucket[own], count[own], BUCKETS).astype(np.int64)
    yield from told()


def _packed(rows: pa.Table) -> pa.Table:
    counts = np.zeros(BUCKETS, np.float32)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()]), "counts": pa.array([counts.tobytes()], pa.binary())})


@dataclass
class Model:
    languages: list[str]
    #: P(n-gram | language), buckets x languages.
    likely: np.ndarray


def fit(docs: DataFrame) -> Model:
    """The n-gram distributions of all languages of docs (text, lang), over all rows where both are given.

    At most MOST_LANGUAGES languages are taken; more raise ValueError. Repeated rows count each.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = checkpointed(rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    packed = {r["lang"]: np.frombuffer(r["counts"], np.float32) for r in counts.groupBy("lang").applyInArrow(_packed, "lang string, counts binary").collect()}
    return model_of(packed)


def model_of(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    seen = np.stack([counts[x].astype(np.float64) for x in languages], 1) if languages else np.zeros((BUCKETS, 0))
    each = seen.sum(0)
    # Each language weighs the same in the pooled distribution; a bucket that none has is as likely as one seen once.
    pooled = (seen / np.maximum(each, 1)).sum(1) + 1 / max(each.sum(), 1)
    pooled /= pooled.sum()
    return Model(languages, ((seen + POOLED * pooled[:, None]) / (each + POOLED)).astype(np.float32))


def _log_likelihood(likely: np.ndarray, share: np.ndarray, owner: np.ndarray, count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(count * np.log((likely * share[owner]).sum(1)), starts)


def _mixed(likely: np.ndarray, share: np.ndarray, owner: np.ndarray, count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """STEPS rounds of expectation and maximisation of every text's proportions."""
    for _ in range(STEPS):
        joint = likely * share[owner]
        joint *= (count / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts, 0)
        share /= share.sum(1)[:, None]
    return share


def proportions(texts: list[str], model: Model) -> np.ndarray:
    """Each text's proportions of the model's languages; 0 outside the chosen set, and everywhere for a text without letters."""
    out = np.zeros((len(texts), len(model.languages)))
    owner, bucket, count = grams(texts)
    if not len(owner) or not model.languages:
        return out
    _, letter = _letters()
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    told = owner[starts]
    owner = np.repeat(np.arange(len(told)), np.diff(np.append(starts, len(owner))))
    likely, count = model.likely[bucket], count.astype(np.float32)
    total = np.add.reduceat(count, starts)
    k = len(model.languages)
    single = np.add.reduceat(count[:, None] * np.log(likely), starts, 0).astype(np.float64)
    share = _mixed(likely, np.full((len(told), k), 1 / k, np.float32), owner, count, starts)
    rank = np.argsort(-share, 1, kind="stable")
    best = single.max(1)
    chosen = np.zeros((len(told), k))
    chosen[np.arange(len(told)), single.argmax(1)] = 1
    penalty = PENALTY * np.log2(total + 1)
    whole = _log_likelihood(likely, share, owner, count, starts)
    # No set can beat the whole one before its penalty, so most texts are settled here.
    open_ = whole - penalty > best
    for size in range(2, k + 1):
        texts_left = np.flatnonzero(open_)
        if not len(texts_left):
            break
        rows = np.flatnonzero(open_[owner])
        own = np.searchsorted(texts_left, owner[rows])
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        inside = np.zeros((len(texts_left), k), np.float32)
        np.put_along_axis(inside, rank[texts_left, :size], 1, 1)
        first = inside * np.maximum(share[texts_left], np.float32(1e-6))
        first /= first.sum(1)[:, None]
        fitted = _mixed(likely[rows], first, own, count[rows], begins)
        score = _log_likelihood(likely[rows], fitted, own, count[rows], begins) - (size - 1) * penalty[texts_left]
        better = score > best[texts_left]
        best[texts_left[better]] = score[better]
        chosen[texts_left[better]] = fitted[better]
        open_ &= whole - size * penalty > best
    out[told] = chosen
    lettered = np.array([bool(letter[code_points(t)].any()) for t in texts])
    return out * lettered[:, None]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text and any other columns) with lang_pred, score and lang_mix.

    lang_pred is the language of the largest proportion (ties: the first by name),
    score that proportion, lang_mix the whole chosen set as a map. A text that is
    null or has no letter, and any text of a model without languages, gives und,
    score 0 and an empty map. Repeated rows are told each; an empty table gives an
    empty result; further columns that are named as a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "lang_mix")
    name = free_name(kept, "_mix")
    schema = f"{', '.join(f'`{c}` {t}' for c, t in kept.dtypes)}, `{name}` struct<lang_pred: string, score: double, lang_mix: map<string, double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        most = min(BLOCK_POINTS, BLOCK_CELLS // max(len(model.languages), 1))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            told = [proportions(texts[block], model) for block in _blocks([len(t) for t in texts], most)]
            rows = []
            for shares in (x for block in told for x in block):
                used = [(model.languages[i], float(shares[i])) for i in np.flatnonzero(shares)]
                top = int(shares.argmax()) if used else -1
                rows.append({"lang_pred": model.languages[top] if used else UNKNOWN, "score": min(float(shares[top]), 1.0) if used else 0.0, "lang_mix": used})
            kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_mix", pa.map_(pa.string(), pa.float64()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, name])

    mixed = kept.mapInArrow(run, schema)
    return mixed.select(*kept.columns, *[F.col(f"{name}.{x}").alias(x) for x in ("lang_pred", "score", "lang_mix")])
