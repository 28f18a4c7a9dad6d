"""Quality classifier: interpolated modified Kneser-Ney over words.

The model counts three-word n-grams of trusted texts, with the start and the end of a
text as words of their own; lower orders follow from the distinct n-grams above them.
Words that no trusted text has share one event of the lowest order. A document's
perplexity is held against a quantile of trusted texts of its language that the model
was not trained on.

The counts are made first, from blocks of the trusted texts. Order by order, from the
highest, a block sends each distinct n-gram once, with what it adds to its counts, to the
bucket of its hash; the bucket adds up over all blocks, keeps the sums, and answers with
them in the order it was asked. Of each n-gram one block is told that it is the first: that
one counts its context and its suffix for the next lower order.

Then all texts are scored, one slice of them after another, so that the shuffles of one
slice alone are on disk. A block asks the buckets for its n-grams of all orders at once.
What the block is made of goes along, as numbers of its distinct words, and meets the
answers, so texts are read once a slice and may come in any order. Probabilities are worked
out from the sums there; nothing but the counts of counts reaches the driver.

A shuffle moves a hash, in the 5 to 6 bytes that sorted hashes need, and small counts for a
distinct n-gram of a block, however often it occurs. A task holds one block, or what one
bucket is asked by one slice, whatever the size of its partition. N-grams are told apart by
a 64-bit hash there.

KneserNey has the same model as tables that grow with the text. An n-gram's key is the
64-bit hash of each of its words, 8 bytes a word, so contexts and suffixes are parts of
it. The same model runs over characters, five at a time, where a caller asks for no
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BASE, checkpointed, code_points, dealt, forgotten, free_name, mix, parallelism, range_hashes, window_hashes, word_bounds

#: Length of n-grams of characters and of words.
ORDER = 5
WORD_ORDER = 3
#: Bytes of a character or word in a key.
WIDTH = 8
#: N-grams of a block at most, unless one text alone has more; a task holds some 300 bytes for each.
SHARD_ENTRIES = 500_000
#: Characters for each bucket; a task holds the distinct n-grams of a bucket that each block sends.
BUCKET_CHARACTERS = 8_000_000
#: Turns in which the buckets are asked for n-grams of two words or more when counts are made, each with a shuffle of its own.
TURNS = 2
#: Slices of texts that are scored one after another at most, and characters of a slice at least.
SLICES = 12
SLICE_CHARACTERS = 10_000_000
#: Bytes of the rows that are handed on at once.
BATCH_BYTES = 4_000_000
#: Ids that are broadcast at most: 32 MB of eight bytes each.
BROADCAST_IDS = 4_000_000
#: Least discount, so that each context leaves something to the lower order.
LEAST = 0.1
#: Marks before the first word and after the last.
START, END = np.uint64(1), np.uint64(2)


def characters(text: str | None) -> np.ndarray:
    """The code points; runs of blanks are one space."""
    points = code_points(text or "")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    if len(points):
        points = np.where(blank, 32, points)[~(blank & np.concatenate([[False], blank[:-1]]))]
    return points.astype(np.uint64)


def words(text: str | None) -> np.ndarray:
    """Hashes of the words between START and END marks; none for a text without words.

    Ideographs, kana and emoji are words of one character, since no blanks part them.
    """
    points = code_points(text or "")
    starts, ends = word_bounds(points)
    if not len(starts):
        return np.zeros(0, np.uint64)
    alone = np.zeros(0, np.int64) if points.max() < 0x2E80 else np.flatnonzero(((points >= 0x2E80) & (points < 0xA4D0)) | ((points >= 0xF900) & (points < 0xFB00)) | ((points >= 0x1F000) & (points < 0x40000)))
    if len(alone):
        cuts = np.unique(np.concatenate([starts, ends, alone, alone + 1]))
        inside = np.zeros(len(points) + 1, np.int64)
        inside[starts] += 1
        np.subtract.at(inside, ends, 1)
        inside = np.cumsum(inside)
        held = inside[cuts[:-1]] > 0
        starts, ends = cuts[:-1][held], cuts[1:][held]
    marks = np.full(WORD_ORDER - 1, START)
    return np.concatenate([marks, range_hashes(points, starts, ends), [END]])


def grams(text: str | None, of_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a text, and the windows, one row each."""
    order = WORD_ORDER if of_words else ORDER
    tokens = words(text) if of_words else characters(text)
    if len(tokens) < order:
        return np.zeros(0, np.uint64), np.zeros((0, order), np.uint64)
    return window_hashes(tokens, order), np.lib.stride_tricks.sliding_window_view(tokens, order)


def _texts(batches: Iterator[pa.RecordBatch], column: str):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, windows, counts = (np.concatenate(x) for x in zip(*parts))
    found, first, where = np.unique(hashes, return_index=True, return_inverse=True)
    return found, windows[first], np.bincount(where, counts, len(found)).astype(np.int64)


def _keys(windows: np.ndarray) -> pa.Array:
    size = WIDTH * windows.shape[1]
    offsets = np.arange(0, (len(windows) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(windows))])


def gram_counts(texts: DataFrame, text: str = "text", of_words: bool = False) -> DataFrame:
    """(g, k, c): key and hash of each n-gram and how often it occurs. Tasks add up what they read before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def rows(hashes, windows, counts):
            for lo in range(0, len(hashes), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([_keys(windows[part]), pa.array(hashes[part].view(np.int64)), pa.array(counts[part])], names=["g", "k", "c"])

        for _, batch in _texts(batches, text):
            for t in batch:
                hashes, windows = grams(t, of_words)
                if len(hashes):
                    pending.append((hashes, windows, np.ones(len(hashes), np.int64)))
                    size += len(hashes)
                if size > 1_000_000:
                    held = [_merged([*held, *pending])]
                    pending, size = [], 0
                    if len(held[0][0]) > 2_000_000:  # what a task holds stays bounded
                        yield from rows(*held.pop())
        if held or pending:
            yield from rows(*_merged([*held, *pending]))

    return texts.select(text).mapInArrow(run, "g binary, k long, c long").groupBy("g", "k").agg(F.sum("c").alias("c"))


def _suffix(order: int) -> Column:
    """The key of the last order - 1 characters or words."""
    return F.substring("g", WIDTH + 1, WIDTH * (order - 1))


def _context(order: int) -> Column:
    return F.substring("g", 1, WIDTH * (order - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    n = {r["c"]: r["n"] for r in counts.where(F.col("c") <= 4).groupBy("c").agg(F.count("*").alias("n")).collect()}
    return _discounts(*(n.get(i, 0) for i in (1, 2, 3, 4)))


def _discounts(one: int, two: int, three: int, four: int) -> tuple[float, float, float]:
    y = one / (one + 2 * two) if one else 0.5
    of = lambda i, a, b: min(float(i), max(LEAST, i - (i + 1) * y * b / a)) if a else 0.5 * i
    return of(1, one, two), of(2, two, three), of(3, three, four)


class KneserNey:
    """For each order its counts; for each context its total and the weight of the lower order."""

    def __init__(self, texts: DataFrame, text: str = "text", of_words: bool = False):
        self.of_words, self.order = of_words, WORD_ORDER if of_words else ORDER
        self.texts = texts.select(F.col(text).alias("t"))

    @cached_property
    def counts(self) -> dict[int, DataFrame]:
        counts = {self.order: checkpointed(gram_counts(self.texts, "t", self.of_words).select("g", "c"))}
        for order in range(self.order, 1, -1):
            counts[order - 1] = checkpointed(counts[order].groupBy(_suffix(order).alias("g")).agg(F.count("*").alias("c")))
        return counts

    @cached_property
    def discounts(self) -> dict[int, tuple[float, float, float]]:
        return {n: discounts(c) for n, c in self.counts.items()}

    @cached_property
    def _totals(self) -> tuple[int, int]:
        return tuple(self.counts[1].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first())

    @property
    def total(self) -> int:
        return self._totals[0]

    @property
    def alphabet(self) -> int:
        return self._totals[1] + 1

    def _kept(self, order: int) -> Column:
        d1, d2, d3 = self.discounts[order]
        return F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)

    def contexts(self, order: int) -> DataFrame:
        """(h, total, back): back is the share of probability that the lower order gets."""
        d1, d2, d3 = self.discounts[order]
        lost = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        return self.counts[order].groupBy(_context(order).alias("h")).agg(F.sum("c").alias("total"), F.sum(lost).alias("lost")).select("h", "total", (F.col("lost") / F.col("total")).alias("back"))

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """asked, distinct n-grams g of the highest order, with logp: natural logs."""
        return self._of_order(asked, self.order).withColumn("logp", F.log("p")).drop("p")

    def _of_order(self, asked: DataFrame, order: int) -> DataFrame:
        if order == 0:
            return asked.withColumn("p", F.lit(1.0 / self.alphabet))
        if order == 1:
            d1, d2, d3 = self.discounts[1]
            lost = self.counts[1].agg(F.sum(F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))).first()[0] or 0.0
            total = max(1, self.total)
            back = lost / total if self.total else 1.0
            own = F.coalesce(self._kept(1) / total, F.lit(0.0))
            return asked.join(self.counts[1].select("g", "c"), "g", "left").select(*asked.columns, (own + back / self.alphabet).alias("p"))
        lower = self._of_order(asked.select(_suffix(order).alias("g")).distinct(), order - 1)
        lower = lower.select(F.col("g").alias("s"), F.col("p").alias("q"))
        held = self.contexts(order)
        rows = asked.join(self.counts[order], "g", "left").withColumn("h", _context(order)).withColumn("s", _suffix(order))
        rows = rows.join(held, "h", "left").join(lower, "s")
        own = F.coalesce(self._kept(order) / F.col("total"), F.lit(0.0))
        return rows.select(*asked.columns, (own + F.coalesce("back", F.lit(1.0)) * F.col("q")).alias("p"))


def _good(labels: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The ids that a label row calls good. Up to BROADCAST_IDS (then the flag is true) are broadcast; more are joined by a shuffle, which moves the texts."""
    good = labels.where(F.col("quality") == 1).select(key).distinct()
    small = good.count() <= BROADCAST_IDS
    return (F.broadcast(good) if small else good), small


def trusted(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that a label row calls good."""
    return docs.join(_good(labels, key)[0], key, "left_semi")


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as up to eight planes of bytes, which compress to little where numbers are small."""
    if not len(values):
        return bytes(9)
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    values = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), np.uint8)
        values[:, :width] = planes.reshape(width, n).T
    return values.view(np.uint64).reshape(n)


def _order_of(hashes: np.ndarray) -> np.ndarray:
    """argsort: their upper bits are sorted with the places in the lower ones, and that is held against the whole hashes."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).view(np.int64)
    inorder = hashes[order]
    return order if (inorder[1:] >= inorder[:-1]).all() else np.argsort(hashes)


#: What is sent. size: 0 for a block, else the n-gram's. parts: of a block see _Block.packed(); of requests and of the sums that a bucket
#: keeps (there b is -1) keys and sums; of answers counts, marks and contexts. told: how many counts are 1, 2, 3, 4, more than 0, and their sum.
_ROWS = "p long, b long, made_of long, size long, parts array<binary>, told array<long>"
_SCHEMA = pa.schema([("p", pa.int64()), ("b", pa.int64()), ("made_of", pa.int64()), ("size", pa.int64()), ("parts", pa.list_(pa.binary())), ("told", pa.list_(pa.int64()))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[4]))
        if size > BATCH_BYTES:
            yield from _table(held).to_batches()
            held, size = [], 0
    if held:
        yield from _table(held).to_batches()


@dataclass
class _Block:
    """Tokens of some texts, end to end. b: the partition, and the block's number there; made_of: the same for the same texts."""

    b: int
    made_of: int
    tokens: np.ndarray
    lengths: np.ndarray
    trained: np.ndarray
    asked: np.ndarray
    d: np.ndarray

    def packed(self, p: int) -> tuple:
        """A row of _ROWS. Words that are about as frequent are together, so that most numbers are small, and sorted, so that few bytes tell one from the next."""
        _, first, which = self.grams(1)
        found = self.tokens[first]
        order = np.lexsort((found, -np.frexp(np.bincount(which))[1]))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        marks = (_packed(np.asarray(x)) for x in (self.lengths, self.trained, self.asked, self.d))
        return p, self.b, self.made_of, 0, [_packed(np.diff(found[order], prepend=np.uint64(0))), _packed(number[which]), *marks], None

    @staticmethod
    def unpacked(row: dict) -> _Block:
        found, which, lengths, trained, asked, d = map(_unpacked, row["parts"])
        return _Block(row["b"], row["made_of"], np.cumsum(found)[which.astype(np.int64)], lengths.astype(np.int64), trained > 0, asked > 0, d.view(np.int64))

    def starts(self, size: int) -> np.ndarray:
        """Where windows begin that do not leave their text."""
        inside, ends = np.ones(len(self.tokens), bool), np.cumsum(self.lengths)
        for back in range(1, size):
            inside[ends - back] = False
        return np.flatnonzero(inside)

    def hashes(self, size: int) -> np.ndarray:
        """What window_hashes gives for all tokens, without its powers."""
        n = len(self.tokens) - size + 1
        added = np.zeros(n, np.uint64)
        for at in range(size - 1, -1, -1):
            added *= BASE
            added += self.tokens[at : at + n]
            added += np.uint64(1)
        return mix(added)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct n-grams, ascending; where each begins once; for each place the number of the n-gram that begins there."""
        starts = self.starts(size)
        hashes = self.hashes(size)[starts]
        order = _order_of(hashes)
        hashes, starts = hashes[order], starts[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        place = np.full(len(self.tokens), -1, np.int32)
        place[starts] = np.cumsum(new) - 1
        return hashes[new], starts[new], place


def _blocks(batches: Iterator[pa.RecordBatch], order: int, of_words: bool, entries: int) -> Iterator[_Block]:
    """Texts that have n-grams, some at a time."""
    partition = TaskContext.get().partitionId()
    texts: list[tuple[np.ndarray, bool, bool, int]] = []
    size, made = 0, 0

    def block():
        tokens = np.concatenate([x[0] for x in texts])
        marks = (np.array([x[i] for x in texts]) for i in (1, 2, 3))
        return _Block((partition << 32) + made, int(np.sum(tokens).view(np.int64)), tokens, np.array([len(x[0]) for x in texts]), *marks)

    for batch, of_batch in _texts(batches, "t"):
        for text, *marks in zip(of_batch, *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("trained", "asked", "d"))):
            tokens = words(text) if of_words else characters(text)
            if (own := len(tokens) - order + 1) <= 0:
                continue
            if texts and size + own > entries:
                yield block()
                texts, size, made = [], 0, made + 1
            texts.append((tokens, *marks))
            size += own
    if texts:
        yield block()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _of_buckets(hashes: np.ndarray, buckets: int, asked: range) -> np.ndarray:
    """Which hashes are in the buckets asked."""
    bucket = _bucket(hashes, buckets)
    return (bucket >= asked.start) & (bucket < asked.stop)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs. (np.unique without an index is slower than a sort.)"""
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
    return hashes[first], np.diff(first, append=len(hashes))


def _requests(block: _Block, keys: np.ndarray, sums: list[np.ndarray], buckets: int, asked: range) -> Iterator[tuple]:
    """A block's n-grams with what it adds to their sums, a row for each bucket asked."""
    cuts = np.searchsorted(_bucket(keys, buckets), np.arange(asked.start, asked.stop + 1, dtype=np.uint64))
    for at in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[at], cuts[at + 1])
        yield asked[at], block.b, block.made_of, _packed(np.diff(keys[part], prepend=np.uint64(0))), _packed(np.concatenate([s[part] for s in sums])) if sums else b""


def _as_rows(requests: Iterator[tuple], size: int) -> Iterator[tuple]:
    return ((p, b, made_of, size, parts, None) for p, b, made_of, *parts in requests)


def _highest_requests(order: int, buckets: int, asked: range):
    def run(block: _Block):
        hashes, learnt = block.hashes(order)[block.starts(order)], np.repeat(block.trained, block.lengths - order + 1)
        mine = _of_buckets(hashes, buckets, asked)
        keys, _ = _distinct(hashes[mine])
        counted, times = _distinct(hashes[mine & learnt])
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, counted)] = times
        return _requests(block, keys, [counts], buckets, asked)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """A bucket's sums over all blocks, kept, and given back to each block in the order of its n-grams.

    counts, and for those that are not 0 marks: 1 for the first block.
    """
    rows = asked.to_pylist()
    parts = [np.cumsum(_unpacked(r["parts"][0])) for r in rows]
    found, first, where = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    added = np.concatenate([_unpacked(r["parts"][1]).reshape(-1, len(k)) for r, k in zip(rows, parts)], axis=1)
    sums = [np.bincount(where, s, len(found)).astype(np.int64) for s in added]
    counts = sums[0]
    first_of = np.zeros(len(where), bool)
    first_of[first] = True
    cuts = np.cumsum([0, *(len(k) for k in parts)])
    back = []
    for r, part in zip(rows, map(slice, cuts[:-1], cuts[1:])):
        c = counts[where[part]]
        back.append((r["p"], r["b"], r["made_of"], r["size"], [_packed(c), _packed(first_of[part][c > 0])], None))
    told = [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts > 0).sum()), int(counts.sum())]
    kept = [_packed(np.diff(found, prepend=np.uint64(0))), _packed(np.concatenate(sums))]
    return _table([*back, (rows[0]["p"], -1, 0, rows[0]["size"], kept, told)])


def _look_up(kept: pa.Table, asked: pa.Table) -> pa.Table:
    """A bucket's sums for each block, in the order of its n-grams; blocks themselves are handed on.

    counts, no marks, and contexts, but for the highest order: the total, and if that is
    over 1, how many counts are 1, 2 and more.
    """
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in kept.to_pylist():
        keys = np.cumsum(_unpacked(r["parts"][0]))
        sums[r["size"]] = keys, _unpacked(r["parts"][1]).reshape(-1, len(keys))
    back = []
    for batch in asked.to_batches(16):
        for r in batch.to_pylist():
            parts = r["parts"]
            if r["size"]:
                keys = np.cumsum(_unpacked(parts[0]))
                found, own = sums.get(r["size"], (np.zeros(0, np.uint64), np.zeros((1, 0), np.uint64)))
                at = np.searchsorted(found, keys)
                at[at == len(found)] = 0
                held = np.flatnonzero(found[at] == keys) if len(found) else at[:0]
                at = at[held]
                c, *context = np.zeros((len(own), len(keys)), np.uint64)
                for to, x in zip((c, *context), own):
                    to[held] = x[at]
                if context:
                    context = [context[0], *(x[context[0] > 1] for x in context[1:])]
                elif r["size"] == 1 or not len(found):
                    context = [np.zeros(len(keys), np.uint64)]
                parts = [_packed(c), b"", _packed(np.concatenate(context)) if context else b""]
            back.append((r["p"], r["b"], r["made_of"], r["size"], parts, None))
    return _table(back)


def _block_and_answers(blocks: pa.Table, answers: pa.Table) -> tuple[_Block, list[dict]]:
    """A block, and what the buckets answered, in their order."""
    (block,) = blocks.to_pylist()
    told = [r | dict(zip(("counts", "marks", "contexts"), r["parts"])) for r in answers.to_pylist()]
    return _Block.unpacked(block), sorted(told, key=lambda r: r["p"])


def _counts(block: _Block, answers: list) -> np.ndarray:
    """What all buckets answered for a block's n-grams of one order."""
    if any((r["b"], r["made_of"]) != (block.b, block.made_of) for r in answers):
        raise ValueError("the texts came in another order than before; write or checkpoint them first")
    return np.concatenate([_unpacked(r["counts"]) for r in answers]).astype(np.int64)


def _contexts(answers: list) -> np.ndarray:
    """Of the same n-grams as contexts: their total, and how many counts are 1, 2 and more."""
    parts = []
    for r in answers:
        n = int.from_bytes(r["counts"][:8], "little")
        packed = _unpacked(r["contexts"]).astype(np.int64)
        context = np.stack([packed[:n], packed[:n] == 1, np.zeros(n, np.int64), np.zeros(n, np.int64)])
        context[1:, context[0] > 1] = packed[n:].reshape(3, -1)
        parts.append(context)
    return np.concatenate(parts, axis=1)


def _lower_requests(size: int, buckets: int, asked: range):
    """Requests of n-grams of this size, from the answers of the next larger one."""

    def run(pair):
        block, answers = pair
        _, begin, _ = block.grams(size + 1)
        c = _counts(block, answers)
        own = np.flatnonzero(c)[np.concatenate([_unpacked(r["marks"]) for r in answers]) > 0]
        begin, c = begin[own], c[own]
        hashes = block.hashes(size)
        keys, _ = _distinct((every := hashes[block.starts(size)])[_of_buckets(every, buckets, asked)])
        add = lambda at, w=None: np.bincount(at, w, len(keys)).astype(np.int64)
        context, suffix = (x[_of_buckets(x, buckets, asked)] for x in (hashes[begin], hashes[begin + 1]))
        c = c[_of_buckets(hashes[begin], buckets, asked)]
        context, suffix = np.searchsorted(keys, context), np.searchsorted(keys, suffix)
        return _requests(block, keys, [add(suffix), add(context, c), add(context[c == 1]), add(context[c == 2]), add(context[c > 2])], buckets, asked)

    return run


def _of_blocks(requests, size: int):
    return lambda batches: _batches(x for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist() for x in _as_rows(requests(_Block.unpacked(r)), size))


def _of_answers(requests, size: int):
    return lambda block, answers: _table(list(_as_rows(requests(_block_and_answers(block, answers)), size)))


def _log_probabilities(order: int, of_order: dict[int, tuple[float, float, float]], alphabet: int, total: int, back: float):
    """(d, total, n) of the texts that are asked for. back: share of probability that unknown words get."""

    def run(pair):
        block, answers = pair
        begin = block.starts(order)
        p, context = np.full(len(begin), 1.0 / alphabet), None
        for size in range(1, order + 1):
            d1, d2, d3 = of_order[size]
            _, _, place = block.grams(size)
            own = [r for r in answers if r["size"] == size]
            at = begin + order - size
            c = _counts(block, own)[place[at]]
            if context is None:
                totals, left = max(1, total), back
            else:
                totals, one, two, more = (x[context[0][at]] for x in context[1])
                left = np.where(totals > 0, (d1 * one + d2 * two + d3 * more) / np.maximum(totals, 1), 1.0)
            off = np.where(c == 1, d1, np.where(c == 2, d2, d3))
            p = np.where(c > 0, (c - off) / np.maximum(totals, 1), 0.0) + left * p
            context = (place, _contexts(own)) if size < order else None
        grams = block.lengths - order + 1
        logs = np.add.reduceat(np.log(p), np.cumsum(grams) - grams)
        return pa.table({"d": block.d[block.asked], "total": logs[block.asked], "n": grams[block.asked]})

    return run


def _model(rows: DataFrame, of_words: bool, shard_entries: int, buckets: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """What the buckets keep of the texts, dealt by p, and for each order the sums of told."""
    order, n = WORD_ORDER if of_words else ORDER, parallelism(rows.sparkSession)
    blocks = dealt(rows.mapInArrow(lambda batches: _batches(block.packed(0) for block in _blocks(batches, order, of_words, shard_entries)), _ROWS), n, "b")
    answers, kept, told = None, [], {}
    for size in range(order, 0, -1):
        parts = []
        turns = TURNS if size > 1 else 1
        for turn in range(turns):
            part = range(buckets * turn // turns, buckets * (turn + 1) // turns)
            if size == order:
                asked = blocks.mapInArrow(_of_blocks(_highest_requests(order, buckets, part), size), _ROWS)
            else:
                asked = blocks.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_of_answers(_lower_requests(size, buckets, part), size), _ROWS)
            parts.append(dealt(asked.groupBy("p").applyInArrow(_answer, _ROWS), n, "p"))
        whole = reduce(DataFrame.unionByName, parts)
        told[size] = [x or 0 for x in whole.agg(*(F.sum(F.col("told")[i]) for i in range(6))).first()]
        answers = whole.where("b >= 0")
        kept += [x.where("b < 0") for x in parts]
    forgotten(blocks)
    return reduce(DataFrame.unionByName, kept), told


def text_scores(rows: DataFrame, of_words: bool = False, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(d, total, n): sum of the log probabilities of a text's n-grams, and how many they are.

    rows: d, t, trained, asked: an id, a text, whether the model counts it, whether
    its score is asked for. Texts of one id are taken together. The rows are read
    several times.
    """
    spark, order = rows.sparkSession, WORD_ORDER if of_words else ORDER
    rows = rows.select("d", "t", "trained", "asked")
    characters_in_all = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(parallelism(spark), -(-characters_in_all // BUCKET_CHARACTERS))
    kept, told = _model(rows.where("trained"), of_words, shard_entries, buckets)
    of_order = {size: _discounts(*x[:4]) for size, x in told.items()}
    one, two, *_, kinds, total = told[1]
    back = float(np.dot(of_order[1], (one, two, kinds - one - two)) / total) if total else 1.0

    def requests(batches):
        for block in _blocks(batches, order, of_words, shard_entries):
            yield block.packed(block.b % buckets)
            for size in range(1, order + 1):
                keys, _ = _distinct(block.hashes(size)[block.starts(size)])
                yield from _as_rows(_requests(block, keys, [], buckets, range(buckets)), size)

    probabilities = _log_probabilities(order, of_order, kinds + 1, total, back)

    def scored(own):
        is_block = pa.compute.equal(own["size"], 0)
        return probabilities(_block_and_answers(own.filter(is_block), own.filter(pa.compute.invert(is_block))))

    slices = max(1, min(SLICES, characters_in_all // SLICE_CHARACTERS))
    parts = []
    for i in range(slices):
        own = rows.where(F.col("asked") & (F.pmod("d", F.lit(slices)) == i))
        asked = own.mapInArrow(lambda batches: _batches(requests(batches)), _ROWS)
        answers = kept.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(_look_up, _ROWS)
        scores = answers.groupBy("b").applyInArrow(scored, "d long, total double, n long")
        parts.append(checkpointed(scores.groupBy("d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), free_shuffles=True))
    return reduce(DataFrame.unionByName, parts)


def _with_perplexities(docs: DataFrame, sums: DataFrame, text: str, out: str) -> DataFrame:
    digest = free_name(docs, "d")
    sums = sums.select(F.col("d").alias(digest), F.exp(-F.col("total") / F.col("n")).alias(out))
    rows = docs.withColumn(digest, F.xxhash64(text)).join(sums, digest, "left")
    return rows.select(*docs.columns, out)


def perplexities(docs: DataFrame, model: KneserNey, text: str = "text", out: str = "perplexity", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """docs with the column `out` (replaced if there); null for texts without n-grams.

    The model's texts are counted and docs scored in blocks of shard_entries n-grams
    at most. An n-gram is in a block's requests once, so a frequent one makes no
    task larger than others.
    """
    docs = docs.drop(out)
    asked = docs.select(F.xxhash64(text).alias("d"), F.col(text).alias("t"), F.lit(False).alias("trained"), F.lit(True).alias("asked"))
    learnt = model.texts.select(F.lit(0).cast("long").alias("d"), "t", F.lit(True).alias("trained"), F.lit(False).alias("asked"))
    return _with_perplexities(docs, text_scores(asked.unionByName(learnt), model.of_words, shard_entries), text, out)


def _calibration(key: str) -> Column:
    """A fifth of the documents, by a hash of the id: thresholds come from them, the model doesn't."""
    return F.coalesce(F.crc32(F.concat(F.lit("calibration "), F.col(key).cast("string")).cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.99, slack: float = 1.1) -> DataFrame:
    """(key, lang, perplexity, threshold, kept) for each row of docs.

    The model is trained on the documents labelled good, but for the calibration
    fold: a text that was counted is no measure for one that was not. A document is
    kept unless its perplexity is above slack times this quantile of the fold's good
    documents of its language; null languages are a language, one without any uses
    the quantile over all, a fold without any gives way to all good documents, and
    without any good document all are kept. Texts without words, empty and null ones
    too, have no perplexity and are not kept. Repeated rows count as often as they
    occur. Columns of other names are not carried.
    """
    rows = docs.select(key, text, lang)
    ids, small = _good(labels, key)
    marked = rows.select(key, text).join(ids.withColumn("_good", F.lit(True)), key, "left")
    learnt = F.coalesce("_good", F.lit(False)) & ~_calibration(key)
    marked = marked.select(F.xxhash64(text).alias("d"), F.col(text).alias("t"), learnt.alias("trained"), F.lit(True).alias("asked"))
    sums = text_scores(marked if small else checkpointed(marked, free_shuffles=True), of_words=True)  # it is read several times
    scored = checkpointed(_with_perplexities(rows, sums, text, "perplexity").drop(text), free_shuffles=True)
    good = trusted(scored, labels, key)
    if not (fold := good.where(_calibration(key) & F.col("perplexity").isNotNull())).isEmpty():
        good = fold
    quantile_of = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    limits = good.groupBy(lang).agg((quantile_of * slack).alias("own")).withColumnRenamed(lang, "_lang")
    overall = good.agg((quantile_of * slack).alias("all")).first()["all"]
    out = scored.join(limits, scored[lang].eqNullSafe(limits["_lang"]), "left").drop("_lang")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(key, lang, "perplexity", threshold.alias("threshold"), kept.alias("kept"))
