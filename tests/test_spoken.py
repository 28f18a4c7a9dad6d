"""Audio of texts made in numpy against the column expression, and the recogniser against a loop over its windows."""

import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.streaming import audio
from gridloom.streaming.audio import LOUD, heard, spoken

W = 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=80), st.integers(1, 4))
def test_heard_equals_a_loop_over_windows(samples, window):
    points = samples[: len(samples) // window * window : window]
    want = " ".join("".join(chr(p - LOUD) if p > LOUD else " " for p in points).split())
    assert heard(window)(np.array(samples, np.int16)) == want


def test_heard_takes_no_line_of_python_for_each_window():
    n, samples = 0, np.full(W * 100_000, LOUD + 97, np.int16)

    def trace(frame, event, arg):
        nonlocal n
        n += 1
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        assert heard(W)(samples) == "a" * 100_000
    finally:
        sys.settrace(before)
    assert n < 1_000


def test_said_is_spoken_in_batches_of_bounded_size(spark):
    texts = [None, "", " ", "a b", "\t\n\x0b\x0c\r\x1c\x85\xa0  　", "é 漢字 簗簘￿", "😀!", "\x00\x01", "long " * 500] * 3
    rows = spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "session long, said string, at long").coalesce(1)
    want = {r["session"]: r["pcm"] for r in rows.select("session", spoken(F.col("said"), W).alias("pcm")).collect()}
    for most in (1, 1_000, audio.SPOKEN_BYTES):
        got = audio.said(rows, "said", W, most=most)
        assert got.dtypes == [("session", "bigint"), ("at", "bigint"), ("pcm", "binary")]
        assert [(r["session"], r["at"], r["pcm"]) for r in got.collect()] == [(i, -i, want[i]) for i in range(len(texts))]
