"""Chat formatting over reply trees.

Messages form trees by their parent. Self-joins double how far every message's
pointer to an ancestor reaches, so a tree of depth d takes about log2(d) joins and
no message carries more than one pointer. Leaves are ranked by the scores summed up
on the way; the ancestors of the chosen ones alone are then gathered by the pointers
of each length, and each is written as one conversation with marks around its turns.
A conversation is one value in the end, so one long one meets in one task there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Openings of control strings of common templates, as a lookahead after their first character.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """A backslash goes before each backslash and after the first character of a control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(.)"), F.lit("$1"))


def _lifted(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree_id, leaf, score) of all leaves below a root; for each i, (tree_id, node_id, top) with the ancestor 2**i above."""
    own = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = own.where(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull()).groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "score")).alias("m"))
    own = own.select("tree_id", "node_id", F.when(F.col("m.parent_id") != F.col("node_id"), F.col("m.parent_id")).alias("parent_id"), F.col("m.score").alias("score"))
    ids = own.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    own = own.join(ids, ["tree_id", "parent_id"], "left").select("tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("top"), "score")
    ways = first = checkpointed(own)
    levels: list[DataFrame] = []
    before = -1
    while True:
        open_ = ways.where(F.col("top").isNotNull())
        left = open_.count()
        if left in (0, before):  # each round closes a node at least, but for those on a cycle or below one
            break
        levels.append(open_.select("tree_id", "node_id", "top"))
        above = ways.select("tree_id", F.col("node_id").alias("top"), F.col("top").alias("next"), F.col("score").alias("more"))
        longer = open_.join(above, ["tree_id", "top"]).select("tree_id", "node_id", F.col("next").alias("top"), (F.col("score") + F.col("more")).alias("score"))
        ways, before = checkpointed(ways.where(F.col("top").isNull()).unionByName(longer)), left
    parents = first.where(F.col("top").isNotNull()).select("tree_id", F.col("top").alias("node_id"))
    leaves = ways.where(F.col("top").isNull()).join(parents, ["tree_id", "node_id"], "left_anti")
    return leaves.select("tree_id", F.col("node_id").alias("leaf"), "score"), levels


def _ways(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """leaves with a row for each node_id from the root to the leaf; pos rises to 0 at the leaf."""
    columns = leaves.columns
    rows = leaves.withColumns({"node_id": F.col("leaf"), "pos": F.lit(0).cast("long")})
    for i, level in reversed([*enumerate(levels)]):
        here, up = F.struct("node_id", "pos"), F.struct(F.col("top").alias("node_id"), (F.col("pos") - 2**i).alias("pos"))
        both = rows.join(level, ["tree_id", "node_id"], "left").withColumn("x", F.explode(F.when(F.col("top").isNull(), F.array(here)).otherwise(F.array(here, up))))
        rows = both.select(*columns, "x.node_id", "x.pos")
    return rows


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf, path, score): for each leaf the nodes from its root, and their summed score.

    nodes has tree_id, node_id, parent_id, score. A node without a parent, with an
    unknown parent or with itself as parent is a root. Of repeated (tree_id,
    node_id) one row counts, the smallest. Nodes on a cycle or below one have no
    root and no path. Null tree_id or node_id take no part.
    """
    path = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"])
    return _ways(*_lifted(nodes)).groupBy("tree_id", "leaf", "score").agg(path.alias("path")).select("tree_id", "leaf", "path", "score")


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, leaf, score, formatted, loss): the best paths of each tree as conversations.

    nodes has tree_id, node_id, parent_id, score, role, text; further columns are
    not carried. branch numbers the chosen leaves from 1 by falling score, ties by
    the smaller leaf. loss lists the spans (start, end; code points of formatted)
    that hold assistant texts and nothing else. Null roles and texts are empty.
    Of repeated (tree_id, node_id) one row counts, the smallest; see paths().
    """
    by_score = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")
    leaves, levels = _lifted(nodes)
    chosen = leaves.withColumn("branch", F.row_number().over(by_score)).where(F.col("branch") <= branches)
    words = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    words = words.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "own", "role", "text")).alias("m")).select("tree_id", "node_id", "m.role", "m.text")
    turns = _ways(chosen, levels).join(words, ["tree_id", "node_id"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR))
    turns = turns.select("tree_id", "branch", "leaf", "score", "pos", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("tree_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    ordered = turns.groupBy("tree_id", "branch", "leaf", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", span.alias("span")))).alias("t"))
    loss = F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull())
    return ordered.select("tree_id", "branch", "leaf", "score", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        sides = F.split(part, r"<\|im_sep\|>", -1)
        return F.struct(unescape(F.get(sides, F.lit(0))).alias("role"), unescape(F.regexp_replace(F.get(sides, F.lit(1)), r"<\|im_end\|>$", "")).alias("text"))

    return F.transform(turns, turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text of all spans, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def as_chains(conversations: DataFrame) -> DataFrame:
    """Nodes for format_paths: the turns of each conv_id in one chain, ordered by turn.

    Equal turns are ordered by role, then text; a null conv_id is no conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("tree_id"), "role", "text", F.row_number().over(order).alias("node_id"))
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))
