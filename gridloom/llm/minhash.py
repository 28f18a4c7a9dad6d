"""Near duplicates by DartMinHash signatures and banded joins.

A text is the weighted set of its five-word shingles, weights being counts. Every
unit of an element's weight is a region that hashed darts hit as a Poisson process
along the rank axis; a dart falls on one coordinate of the signature. Darts below a
rank that leaves about k ln k + 2k of them are thrown, the earliest on each
coordinate is its value, and the rank is doubled while a coordinate is empty. Two
texts agree on a coordinate with the probability of their weighted Jaccard
similarity. Texts with an equal band of coordinates meet and are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import checkpointed, code_points, free_name, mix, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Texts with more units than this beyond a hub may meet a partner several times; results don't depend on it.
CARRIED = 512
#: A join deals groups of more rows than this over several tasks; at most so many groups, whose keys are broadcast.
DEALT_ROWS, DEALT_GROUPS = 1_000, 100_000

_STEP = np.uint64(0xD1342543DE82EF95)
_COORDINATE, _VALUE, _POSITION, _UNIT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x8CB92BA72F3D8DD7))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes | None]:
    """Distinct shingle hashes, their counts, and a digest of the sequence of words.

    Case and the kind of blanks don't count. A text of fewer than five words is one
    shingle; one without words has none, and no digest.
    """
    words, _, _ = word_hashes(code_points((text or "").lower()))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    hashes, counts = np.unique(window_hashes(words, min(SHINGLE, len(words))), return_counts=True)
    return hashes, counts, hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each region of up to one unit of weight, and how much of the unit it has."""
    cells = np.ceil(weights).astype(np.int64)
    first = np.cumsum(cells) - cells
    unit = np.arange(cells.sum()) - np.repeat(first, cells)
    share = np.minimum(1.0, np.repeat(weights.astype(np.float64), cells) - unit)
    return mix(np.repeat(elements, cells) + unit.astype(np.uint64) * _UNIT), share


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k signature values (uint64) of a non-empty set with positive weights."""
    cells, share = regions(elements, weights)
    limit = (k * np.log(k) + 2 * k) / float(weights.sum())
    while True:
        ranks, darts = [], []
        open_, at, thrown = cells, np.zeros(len(cells)), 0
        part = share
        while len(open_):
            n = max(4, int(np.ceil(limit + 3 * np.sqrt(limit) - (at.min() if thrown else 0))) + 2)
            number = np.arange(thrown + 1, thrown + n + 1, dtype=np.uint64)
            dart = mix(open_[:, None] + number[None, :] * _STEP)
            rank = at[:, None] + np.cumsum(-np.log(_uniform(dart)), axis=1)
            hit = rank < limit
            if (part < 1.0).any():
                hit &= _uniform(mix(dart + _POSITION)) < part[:, None]
            ranks.append(rank[hit])
            darts.append(dart[hit])
            more = rank[:, -1] < limit
            open_, at, part, thrown = open_[more], rank[more, -1], part[more], thrown + n
        rank, dart = np.concatenate(ranks), np.concatenate(darts)
        last_to_first = np.argsort(-rank, kind="stable")
        dart = dart[last_to_first]
        coordinate = (mix(dart + _COORDINATE) % np.uint64(k)).astype(np.int64)
        values, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        values[coordinate] = mix(dart + _VALUE)
        filled[coordinate] = True
        if filled.all():
            return values
        limit *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band; equal bands at different places have different keys."""
    rows = signature.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _UNIT)
    for column in rows.T:
        key = mix(key * _STEP + column)
    return key.astype(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sign(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                digests, bands = [], []
                for t in _column(batch, text).to_pylist():
                    elements, counts, digest = shingles(t)
                    digests.append(digest)
                    bands.append(band_keys(dart_minhash(elements, counts)) if digest else [])
                yield pa.RecordBatch.from_arrays([_column(batch, key), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "t", "bands"])

    return run


def _weighted_set(key: str, text: str):
    """Every unit of weight as one 64-bit number, so that sets compare like weighted sets."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                digests, sets = [], []
                for t in _column(batch, text).to_pylist():
                    elements, counts, digest = shingles(t)
                    digests.append(digest)
                    units = regions(elements, counts)[0] if digest else elements
                    sets.append(np.unique(units).view(np.int64))
                yield pa.RecordBatch.from_arrays([_column(batch, "t"), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["t", "found", "units"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(t, label): the smallest member of the component of each end of the edges (a, b).

    Labels sink to the least of all neighbours' labels, then to that label's own
    label, until none changes. No task holds a component.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("t"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("t", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "t")
        lower = labels.join(near, "t").select("t", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("t").alias("new"), F.col("label").alias("far"))
        lower = lower.join(jump, "new").select("t", "label", F.least("new", "far").alias("new"))
        lower = checkpointed(lower)
        changed = not lower.where(F.col("new") != F.col("label")).isEmpty()
        labels = lower.select("t", F.col("new").alias("label"))
        if not changed:
            return labels


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sets x and y of their texts."""
    one = sets.select(F.col("t").alias("a"), F.col("units").alias("x"))
    two = sets.select(F.col("t").alias("b"), F.col("units").alias("y"))
    return pairs.join(one, "a").join(two, "b")


def _similar(common: Column, w: Column, v: Column) -> Column:
    """Whether sets of sizes w and v with so many common units are near duplicates."""
    return common >= SIMILARITY * (w + v - common)


#: Near duplicates of sizes w and v have this share of w + v in common at least.
_LEAST = SIMILARITY / (1 + SIMILARITY) * (1 - 1e-9)


def _stars(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(t, hub, common, w, v): each text of a bucket with the hub of that bucket, their common units and sizes.

    A bucket's hub is its text with the largest buckets in all bands: of copies with
    edits of their own, that is the text nearest to what they were copied from.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    reach = members.join(sizes, "bucket").groupBy("t").agg(F.sum("n").alias("reach"))
    hubs = members.join(reach, "t").groupBy("bucket").agg(F.max(F.struct("reach", F.xxhash64("t").alias("h"), "t")).alias("m")).select("bucket", F.col("m.t").alias("hub"))
    pairs = members.join(hubs, "bucket").where(F.col("t") != F.col("hub")).select(F.col("t").alias("a"), F.col("hub").alias("b")).distinct()
    return checkpointed(_joined(pairs, sets).select(F.col("a").alias("t"), F.col("b").alias("hub"), F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("w"), F.size("y").alias("v")))


def _beyond_hubs(stars: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that have a hub but no label in common and may be near duplicates.

    Common units of two texts are units of the hub, no more than either shares with
    it, or units that both have beyond it. So pairs whose shares with the hub are not
    enough must agree on units beyond it, of which a text has so many that leaving out
    one less than it needs still keeps one of them. Pairs meet at the first unit that
    both have. No near duplicate is left out.
    """
    own = labels.select("t", "label")
    rows = stars.select("t", "hub", "common", "w").join(own, "t", "left").withColumn("label", F.coalesce("label", "t"))
    rows = rows.join(own.select(F.col("t").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    rows = rows.select("t", "hub", "common", "w", "label", (F.col("label") == F.coalesce("hub_label", "hub")).alias("linked"))
    mixed = rows.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("w").alias("least")).where(F.col("lo") != F.col("hi")).select("hub", "least")
    rows = rows.join(mixed, "hub")
    needed = F.col("w") >= _LEAST * (F.col("w") + F.col("least"))  # as many as the least partner asks for
    rows = checkpointed(rows.where(needed).withColumn("cap", F.col("common") / _LEAST - F.col("w")))
    other = lambda df: df.select("hub", *[F.col(c).alias(f"{c}2") for c in df.columns if c not in ("hub", "unit")], *[c for c in df.columns if c == "unit"])
    apart = (F.col("label") != F.col("label2")) & (F.col("linked2") | (F.col("t") < F.col("t2")))
    ordered = (F.least("t", "t2").alias("a"), F.greatest("t", "t2").alias("b"))
    # Enough units of the hub.
    able = rows.where(F.col("cap") >= F.col("least")).drop("least")
    free = able.where(~F.col("linked"))
    most = free.groupBy("hub").agg(F.max("cap").alias("most"))
    within = able.join(most, "hub").where(F.col("w") <= F.col("most")).drop("most")
    by_hub = free.join(other(within), "hub").where(apart & (F.col("w") <= F.col("cap2")) & (F.col("w2") <= F.col("cap"))).select(*ordered)
    # Units beyond the hub: those that texts of different labels have, rare ones first.
    beyond = _joined(rows.select(F.col("t").alias("a"), F.col("hub").alias("b"), "label"), sets)
    units = checkpointed(beyond.select(F.col("a").alias("t"), F.col("b").alias("hub"), "label", F.explode(F.array_except("x", "y")).alias("unit")))
    met = units.groupBy("hub", "unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where(F.col("lo") != F.col("hi"))
    ranked = F.struct("n", "unit").alias("unit")
    lists = units.drop("label").join(met.select("hub", "unit", "n"), ["hub", "unit"]).select("t", "hub", ranked).groupBy("t", "hub").agg(F.sort_array(F.collect_list("unit")).alias("more"))
    least = F.greatest("least", SIMILARITY * F.col("w"))
    need = F.greatest(F.lit(1), F.ceil(_LEAST * (F.col("w") + least) - F.col("common"))).cast("int")
    lists = checkpointed(rows.drop("cap").join(lists, ["t", "hub"]).withColumn("need", need).where(F.size("more") >= F.col("need")))
    units = lists.select("t", "hub", "common", "w", "label", "linked", F.when(F.size("more") <= CARRIED, F.col("more")).alias("more"), F.explode(F.slice("more", F.lit(1), F.size("more") - F.col("need") + 1)).alias("unit"))
    shared = F.array_intersect("more", "more2")
    enough = F.size(shared) + F.least("common", "common2") >= _LEAST * (F.col("w") + F.col("w2"))
    first = F.coalesce((F.array_min(shared) == F.col("unit")) & enough, F.lit(True))
    by_unit = units.where(~F.col("linked")).join(other(units), ["hub", "unit"]).where(apart & first).select(*ordered)
    return by_hub.unionByName(by_unit).distinct()


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, t, bands) for each row of docs, and (t, label) for each text with a near duplicate.

    Texts with the same words share t (null without words). All texts of a bucket are
    compared with its hub; then those still in different components with one another,
    where _beyond_hubs() doesn't rule it out. So no link that would join two
    components is left out, and neither copies nor near copies make all their pairs.
    """
    signed = checkpointed(docs.select(key, text).mapInArrow(_sign(key, text), f"doc {docs.schema[key].dataType.simpleString()}, t binary, bands array<bigint>"))
    texts = signed.where(F.col("t").isNotNull()).groupBy("t").agg(F.min("doc").alias("doc"), F.min("bands").alias("bands"))
    members = texts.select("t", "doc", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket")
    members = checkpointed(members.join(shared, "bucket"))
    involved = members.select("t", "doc").distinct()
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    sets = source.join(involved, source["doc"].eqNullSafe(involved["doc"])).select("t", "text").mapInArrow(_weighted_set("t", "text"), "t binary, found binary, units array<bigint>")
    sets = checkpointed(sets.where(F.col("t") == F.col("found")).groupBy("t").agg(F.min("units").alias("units")))
    stars = _stars(members.select("bucket", "t"), sets)
    edges = stars.where(_similar(F.col("common"), F.col("w"), F.col("v"))).select(F.col("t").alias("a"), F.col("hub").alias("b"))
    labels = connected(edges)
    pairs = checkpointed(_beyond_hubs(stars, sets, labels))
    common = F.size(F.array_intersect("x", "y"))
    more = checkpointed(_joined(pairs, sets).where(_similar(common, F.size("x"), F.size("y"))).select("a", "b"))
    return signed, labels if more.isEmpty() else connected(edges.unionByName(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size): one row for each row of docs.

    class_id is the smallest key of all rows in a class of texts that are linked by
    equal words or by a weighted Jaccard similarity of five-word shingles of at
    least SIMILARITY, also over several links. Rows without words (null and empty
    texts too) are a class of their own: their key, size 1. Repeated rows are copies.
    A null key is only the id of a class if its rows have no other. An empty table
    gives no rows. Columns other than key and text are not read.
    """
    signed, labels = text_classes(docs, key, text)
    total = signed.count()
    texts = checkpointed(signed.where(F.col("t").isNotNull()).groupBy("t").agg(F.min("doc").alias("class_id"), F.count("*").alias("n")).join(labels, "t", "left"))
    linked = texts.where(F.col("label").isNotNull())
    classes = checkpointed(linked.groupBy("label").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n")))
    linked = _dealt_join(linked.select("t", "label", F.col("n").alias("copies")), classes, "label", "t", total).select("t", "class_id", "class_size", F.col("copies").alias("n"))
    alone = texts.where(F.col("label").isNull()).select("t", "class_id", F.col("n").alias("class_size"), "n")
    rows = _dealt_join(signed.where(F.col("t").isNotNull()).select("doc", "t"), checkpointed(alone.unionByName(linked)), "t", "doc", total)
    wordless = signed.where(F.col("t").isNull()).select("doc", F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return rows.select("doc", "class_id", "class_size").unionByName(wordless).withColumnRenamed("doc", key)


def _dealt_join(rows: DataFrame, groups: DataFrame, on: str, by: str, total: int) -> DataFrame:
    """rows with the columns of their group: groups has one row for each value of `on` and n, how many rows have it.

    The rows of a large group are dealt by a hash of `by`, and the group's row is
    copied to each part. At most total / DEALT_ROWS groups are large, and never more
    than DEALT_GROUPS.
    """
    most = max(DEALT_ROWS, -(-total // DEALT_GROUPS))
    parts = F.ceil(F.col("n") / most).cast("int")
    large = groups.where(F.col("n") > most).select(on, parts.alias("parts"))
    dealt = rows.join(F.broadcast(large), on, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), [on, "part"]).drop("part")


def _digests(text: str, out: str):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t)[2] for t in _column(batch, text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return run


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near_duplicates(), that of the smallest key.

    Rows without words all stay. Of repeated rows one stays.
    """
    signed, labels = text_classes(docs, key, text)
    texts = signed.where(F.col("t").isNotNull()).groupBy("t").agg(F.min(F.struct(F.col("doc").isNull().alias("z"), "doc")).alias("d"))
    texts = texts.join(labels, "t", "left").withColumn("label", F.coalesce("label", "t"))
    first = texts.groupBy("label").agg(F.min(F.struct("d.z", "d.doc", "t")).alias("m")).select(F.col("m.doc").alias("doc"), F.col("m.t").alias("t"))
    t, n = free_name(docs, "t"), free_name(docs, "n")
    marked = docs.mapInArrow(_digests(text, t), T.StructType([*docs.schema.fields, T.StructField(t, T.BinaryType())]))
    first = first.select(F.col("doc").alias(n), F.col("t").alias(f"{n}t"))
    kept = marked.join(first, (marked[t] == first[f"{n}t"]) & marked[key].eqNullSafe(first[n]), "left_semi").dropDuplicates([key, t])
    return kept.unionByName(marked.where(F.col(t).isNull())).drop(t)
