"""Kneser-Ney in blocks: what is sent, and that it is the same for any cut."""

import numpy as np
import pytest

from gridloom.llm import kneser_ney


def test_an_ngram_is_sent_once_in_few_bytes():
    rng = np.random.default_rng(4)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3_000, 60_000))
    tokens = kneser_ney.words(text)
    block = kneser_ney._Block(0, 0, tokens, np.array([len(tokens)]), np.ones(1, bool), np.ones(1, bool), np.zeros(1, np.int64))
    rows = list(kneser_ney._highest_requests(3, 4, range(4))(block))
    keys = np.concatenate([np.cumsum(kneser_ney._unpacked(r[3])) for r in rows])
    assert (keys == block.grams(3)[0]).all()
    assert sum(kneser_ney._unpacked(r[4]).sum() for r in rows) == len(tokens) - 2
    assert sum(len(r[3]) + len(r[4]) for r in rows) < 8 * len(keys)  # three words were 24 bytes


def test_scores_are_the_same_for_any_cut(spark):
    texts = [f"a b c d{i % 7} e f g{i % 3}" for i in range(60)]
    rows = spark.createDataFrame([(i, t, i % 3 == 0, True) for i, t in enumerate(texts)], "d long, t string, trained boolean, asked boolean")
    whole, cut = ({r["d"]: (r["n"], r["total"]) for r in kneser_ney.text_scores(rows, True, n).collect()} for n in (1_000, 5))
    assert len(whole) == 60 and all(cut[d] == pytest.approx(x) for d, x in whole.items())


def test_another_order_of_texts_is_refused():
    block = kneser_ney._Block(3, 5, *[np.zeros(1, np.uint64)] * 5)
    with pytest.raises(ValueError, match="another order"):
        kneser_ney._counts(block, [{"b": 3, "made_of": 6, "counts": kneser_ney._packed(np.zeros(1))}])
    assert kneser_ney._counts(block, [{"b": 3, "made_of": 5, "counts": kneser_ney._packed(np.ones(1))}]).tolist() == [1]
