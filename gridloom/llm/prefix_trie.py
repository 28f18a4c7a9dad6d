"""A trie of all conversations' prefixes, merged family first.

All conversations of one base id meet in one group, where they are rebuilt and make
the family's own small trie; only those nodes are shuffled and merged over families.
Every ancestor of a node is in each family that has the node. So a node's worth goes
back to one family, that of its smallest member, is summed up on the way to the root
there, and the families' sums are added: no round for each level of depth.

Texts never enter a group: a turn is a digest of 16 bytes and its number of words. A
node's key is a digest of its parent's key and its turn's digest (128 bits).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, checkpointed

#: So many following ids have one base id; prefixes of fewer than OPENINGS turns come from there.
FAMILY, OPENINGS = 20, 4
#: A chunk holds the ids of a node within so many following ids.
CHUNK = 100 * FAMILY
#: At most so many nodes are broadcast.
HOT = 1_000
ROOT = b""

NODE = pa.schema([("family", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))])
NODE_SQL = "family long, key binary, parent binary, depth long, conv_id long, n_convs long, words long, ends array<long>"
SUM = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
SUM_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def opening(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % OPENINGS


def family_nodes(rows: pa.Table) -> pa.Table:
    """The trie of one family: rows has family, conv_id, turn, digest, words."""
    family = rows["family"][0].as_py()
    turns: dict[int, list] = {}
    for c, turn, digest, words in zip(*(rows[x].to_pylist() for x in ("conv_id", "turn", "digest", "words"))):
        turns.setdefault(c, []).append((turn is not None, turn or 0, digest, words))
    for own in turns.values():
        own.sort()
    base = turns.get(family, [])[: OPENINGS - 1]
    nodes: dict[bytes, list] = {}
    for c in sorted(turns):
        taken = opening(c)
        key, parent, words = ROOT, None, 0
        path = base[:taken] + turns[c][taken:]
        for depth in range(len(path) + 1):
            if depth:
                *_, digest, words = path[depth - 1]
                key, parent = blake2b(key + digest, digest_size=16).digest(), key
            node = nodes.setdefault(key, [parent, depth, c, 0, words, []])
            node[3] += 1
        nodes[key][5].append(c)
    return pa.Table.from_arrays([pa.array([family] * len(nodes), pa.int64()), pa.array(nodes, pa.binary()), *(pa.array(x, f.type) for x, f in zip(zip(*nodes.values()), list(NODE)[2:]))], schema=NODE)


def family_sums(rows: pa.Table) -> pa.Table:
    """What one family adds to its nodes: rows has family, key, parent, depth, words and, over all families, top, n_convs, n_ends.

    A node counts in the family of its smallest member alone.
    """
    nodes = {r["key"]: r for r in rows.to_pylist()}
    sums = {k: [0, 0, 0] for k in nodes}
    out = []
    for k, r in sorted(nodes.items(), key=lambda x: -x[1]["depth"]):
        owned = r["top"] - _rest(r["top"]) == r["family"]
        if owned:
            sums[k][1] += r["n_convs"] == r["n_ends"]
            sums[k][2] += (r["n_convs"] - 1) * r["words"]
        above = nodes[r["parent"]] if r["depth"] else None
        if above:
            up = sums[r["parent"]]
            up[0] += owned
            up[1] += sums[k][1]
            up[2] += sums[k][2]
        if owned or any(sums[k]):
            out.append((r["top"], r["depth"], above["top"] if above and owned else None, r["n_convs"], *sums[k]))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SUM)], schema=SUM) if out else SUM.empty_table()


def _rest(conv_id: int) -> int:
    """conv_id % FAMILY with the sign of conv_id, as SQL has it."""
    return conv_id % FAMILY if conv_id >= 0 else -(-conv_id % FAMILY)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each following run of (conv_id, depth); only one chunk is held at a time."""
    node, state = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def told(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    for batch in batches:
        done = []
        for c, depth, ids in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "depth", "ids"))):
            if (c, depth) == node:
                state.update(b",")
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (c, depth), sha256()
            state.update(ids.encode())
        if done:
            yield told(done)
    if node:
        yield told([(*node, state.hexdigest())])


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where conversations end; a node's ids are read in ascending chunks."""
    chunks = nodes.where(F.size("ends") > 0).groupBy("conv_id", "depth", F.expr(f"family div {CHUNK}").alias("chunk"))
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("family", "ends"))), lambda x: x["ends"]))
    texts = chunks.agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns over the rebuilt conversations.

    conversations has conv_id, turn, role, text; further columns are not read. Turns
    are ordered by turn, null first, then by a digest of role and text, so repeated
    rows are turns of their own. Null roles and texts are empty; a null conv_id is
    no conversation. Conversation c is rebuilt from the first h turns of c - c % 20
    and its own after its first h; see opening(). Columns: conv_id (the smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. An empty table has no node, not even a root.
    A group holds the digests of one base id's turns, some 100 bytes each.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).cast("long").alias("family"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    families = checkpointed(turns.groupBy("family").applyInArrow(family_nodes, NODE_SQL))
    merged = families.groupBy("key").agg(F.min("conv_id").alias("top"), F.sum("n_convs").alias("n_convs"), F.sum(F.size("ends")).alias("n_ends"), F.count("*").alias("families"))
    merged = checkpointed(merged)
    # A node of so many families is one of HOT at most: their counts add up to the rows of families.
    many = families.count() // HOT + 1
    own = families.select("family", "key", "parent", "depth", "words", "ends")
    hot = own.join(F.broadcast(merged.where(F.col("families") >= many)), "key")
    rest = own.join(F.broadcast(merged.where(F.col("families") >= many).select("key")), "key", "left_anti").join(merged.where(F.col("families") < many), "key")
    whole = checkpointed(hot.unionByName(rest).drop("families"))
    sums = whole.drop("ends").groupBy("family").applyInArrow(family_sums, SUM_SQL).groupBy("conv_id", "depth")
    nodes = sums.agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), *(F.sum(x).alias(x) for x in ("n_children", "n_leaves", "saved_tokens")))
    ends = _end_digests(whole.select(F.col("top").alias("conv_id"), "depth", "family", "ends"))
    return nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


#: The trie in SQL: sequences are lists, crc32 is worked out bit by bit.
SQL = """
WITH own AS (SELECT conv_id AS c, coalesce("role", '') AS r, coalesce("text", '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce("role", '')) || ':' || coalesce("role", '') || coalesce("text", ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT ids.c, 0 AS own, i, r, t FROM ids JOIN own ON own.c = ids.c - ids.c % 20 AND i <= h UNION ALL SELECT ids.c, 1, i, r, t FROM ids JOIN own ON own.c = ids.c AND i > h),
seqs AS (SELECT ids.c, coalesce(s, []) AS s FROM ids LEFT JOIN (SELECT c, list({'r': r, 't': t} ORDER BY own, i) AS s FROM rebuilt GROUP BY c) USING (c)),
prefixes AS (SELECT c, s[1:d] AS s, d, d = len(s) AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT s, d, min(c) AS c, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ends FROM prefixes GROUP BY s, d),
kids AS (SELECT s[1:d - 1] AS s, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
worth AS (SELECT nodes.s, nodes.d, CAST(kids.n IS NULL AS BIGINT) AS leaf, CASE WHEN nodes.d = 0 THEN 0 ELSE (nodes.n - 1) * len(regexp_extract_all(nodes.s[-1].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM nodes LEFT JOIN kids ON kids.s = nodes.s),
sums AS (SELECT s[1:a] AS s, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT s, leaf, saved, unnest(range(d + 1)) AS a FROM worth) GROUP BY 1)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.s = nodes.s LEFT JOIN kids ON kids.s = nodes.s LEFT JOIN nodes up ON up.s = nodes.s[1:nodes.d - 1] AND up.d = nodes.d - 1
"""
