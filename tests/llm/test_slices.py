"""Kneser-Ney over texts in any order and in slices; checkpoints that stay dealt."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import kneser_ney
from gridloom.llm.common import dealt, forgotten

TEXTS = [f"a b c d{i % 7} e f g{i % 3} h{i % 11}" for i in range(120)]
SCHEMA = "d long, t string, trained boolean, asked boolean"


def scores(rows, n):
    return {r["d"]: (r["n"], r["total"]) for r in kneser_ney.text_scores(rows, True, n).collect()}


def test_texts_may_come_in_another_order_at_each_read(spark):
    def in_any_order(batches):
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    rows = spark.createDataFrame([(i, t, i % 3 == 0, i % 5 > 0) for i, t in enumerate(TEXTS)], SCHEMA)
    whole, mixed = scores(rows, 10_000), scores(rows.mapInArrow(in_any_order, SCHEMA), 25)
    assert len(whole) == 96 and whole.keys() == mixed.keys()
    assert all(mixed[d] == pytest.approx(x) for d, x in whole.items())


def test_scores_are_the_same_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i - 60, t, i % 3 == 0, True) for i, t in enumerate(TEXTS)], SCHEMA)
    whole = scores(rows, 10_000)
    monkeypatch.setattr(kneser_ney, "SLICE_CHARACTERS", 500)
    cut = scores(rows, 50)
    assert len(whole) == 120 and whole.keys() == cut.keys() and all(cut[d] == pytest.approx(x) for d, x in whole.items())


def test_a_block_goes_along_in_few_bytes():
    rng = np.random.default_rng(3)
    texts = [kneser_ney.words(" ".join(f"w{i}" for i in rng.zipf(1.3, 500) % 20_000)) for _ in range(60)]
    tokens, asked = np.concatenate(texts), np.arange(60) % 2 == 0
    block = kneser_ney._Block(7, 9, tokens, np.array([len(x) for x in texts]), ~asked, asked, np.arange(60) - 30)
    p, b, made_of, size, parts, _ = block.packed(5)
    again = kneser_ney._Block.unpacked({"b": b, "made_of": made_of, "parts": parts})
    assert (p, b, made_of, size) == (5, 7, 9, 0)
    assert all((getattr(block, k) == getattr(again, k)).all() for k in ("tokens", "lengths", "trained", "asked", "d"))
    assert sum(map(len, parts)) < 4 * len(tokens)


def test_a_dealt_table_is_not_moved_again_and_its_files_go(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [dealt(spark.range(50).withColumn("p", F.col("id") % 9), n, "p") for _ in range(2)]
    kept = parts[0].where("id > 3").unionByName(parts[1])
    pairs = kept.groupBy("p").cogroup(spark.range(9).groupBy("id")).applyInArrow(lambda x, y: x.select(["id"]), "id long")
    assert pairs.count() == 96
    assert str(pairs._jdf.queryExecution().executedPlan()).count("hashpartitioning(p#") == 0
    files = parts[0]._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(files)
    forgotten(parts[0])
    assert not os.path.exists(files)


def test_order_is_right_where_upper_bits_agree():
    rng = np.random.default_rng(5)
    spread, near = rng.integers(0, 1 << 63, 5_000).astype(np.uint64), rng.integers(0, 900, 5_000).astype(np.uint64)
    for hashes in (spread, near, near[:1], np.concatenate([spread, spread + np.uint64(1)])):
        assert (hashes[kneser_ney._order_of(hashes)] == np.sort(hashes)).all()
    for values in (spread, near, np.arange(3) - 1, np.zeros(0, np.int64), np.zeros(4, np.int64)):
        assert (kneser_ney._unpacked(kneser_ney._packed(values)).view(np.int64) == values.astype(np.int64)).all()
    assert len(kneser_ney._packed(np.zeros(5_000, np.int64))) < 60
