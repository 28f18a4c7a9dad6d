"""Byte-level BPE by a tree of joins.

A text is cut in halves down to small leaves. A leaf is encoded alone; two
neighbours are joined by encoding anew only a window around the cut. The window
grows on both sides until it ends at a firm place: where a letter is followed by none,
or a blank follows a character that is none. No match of the pattern runs over such a
place and none looks back, so what lies to the left and to the right of the window is
encoded the same with or without the neighbour, and its tokens are final. Joining is
therefore associative, and equal to encoding the whole text. Decoding splits the ids
in halves and concatenates the bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF_CHARS = 4_096
LEAF_IDS = 256
FIRST_WINDOW = 32

#: Encoders of this Python worker, by digest of the rank file and pattern.
_encoders: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver once; its size is that of one vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str):
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encoders:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encoders[key] = tiktoken.Encoding(key[:12], pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encoders[key]


def _firm(text: str, at: int) -> bool:
    """A letter followed by none, or a blank after what is none.

    The pattern's only matches with letters end with them, so one ends at the first
    such place. str.isalpha() holds for its letters alone, str.isspace() for its blanks
    and a few characters more.
    """
    return text[at - 1].isalpha() and not text[at].isalpha() or text[at] in " \n\t\r" and not text[at - 1].isspace()


def _cut_before(text: str, lo: int, hi: int) -> int:
    """The last firm place in text[lo:hi], or lo."""
    size = FIRST_WINDOW
    while True:
        start = max(lo, hi - size)
        for at in range(hi - 1, start, -1):
            if _firm(text, at):
                return at
        if start == lo:
            return lo
        size *= 2


def _cut_after(text: str, lo: int, hi: int) -> int:
    """The first firm place in text[lo:hi], or hi."""
    for at in range(lo + 1, hi):
        if _firm(text, at):
            return at
    return hi


def encode_tree(text: str, encode, lo: int = 0, hi: int | None = None, leaf: int = LEAF_CHARS) -> np.ndarray:
    """Ids of text[lo:hi]; encode gives those of a string."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return np.asarray(encode(text[lo:hi]), np.uint32)
    mid = (lo + hi) // 2
    left, right = encode_tree(text, encode, lo, mid, leaf), encode_tree(text, encode, mid, hi, leaf)
    start, stop = _cut_before(text, lo, mid), _cut_after(text, mid, hi)
    stale_left, stale_right = len(encode(text[start:mid])), len(encode(text[mid:stop]))
    window = np.asarray(encode(text[start:stop]), np.uint32)
    return np.concatenate([left[: len(left) - stale_left], window, right[stale_right:]])


def decode_tree(ids: np.ndarray, decode, lo: int = 0, hi: int | None = None, leaf: int = LEAF_IDS) -> bytes:
    hi = len(ids) if hi is None else hi
    if hi - lo <= leaf:
        return decode(ids[lo:hi].tolist())
    mid = (lo + hi) // 2
    return decode_tree(ids, decode, lo, mid, leaf) + decode_tree(ids, decode, mid, hi, leaf)


def _rows(batches: Iterator[pa.RecordBatch], column: str, size: int):
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()


def _with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the array<int> column `ids` (replaced if there); null texts count as empty.

    Each row is encoded in its task, so its memory is that of one text and its
    tree; the rank file, of one vocabulary's size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    docs = docs.drop(ids)

    def run(batches):
        encode = encoder(shared.value, pattern).encode_ordinary
        for batch, texts in _rows(batches, text, 64):
            found = [encode_tree(t or "", encode) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
            yield _with_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets), flat)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_ids(rows: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded", digest: str | None = None) -> DataFrame:
    """rows with the binary column `out` (replaced if there); null ids give no bytes.

    digest names a further column: SHA-256 of the ids as little-endian 32-bit integers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    rows = rows.drop(out, *([digest] if digest else []))

    def run(batches):
        decode = encoder(shared.value, pattern).decode_bytes
        for batch, lists in _rows(batches, ids, 64):
            arrays = [np.asarray(x or [], "<u4") for x in lists]
            added = {out: pa.array([decode_tree(x, decode) for x in arrays], pa.binary())}
            if digest:
                added[digest] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in arrays])
            yield _with_columns(batch, added)

    fields = [T.StructField(out, T.BinaryType())] + [T.StructField(digest, T.StringType())] * bool(digest)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))
