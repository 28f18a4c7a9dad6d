"""What the toxicity solver holds, and where it ends."""

import tracemalloc

import numpy as np
from gridloom.llm import toxicity


def parts(n, hashes, rng):
    rows = [rng.integers(0, 1 << toxicity.HASH_BITS, hashes) for _ in range(n)]
    rows = [np.concatenate([r, r[: hashes // 8], r[:3]]) for r in rows]
    marks = [float(i % 3 == 0) for i in range(n)]
    held = [[x.astype(np.int32).tobytes() for x in part] for part in zip(*map(toxicity.by_times, rows))]
    return rows, marks, [(*held, marks)]


def test_the_solver_ends_where_the_slope_is_flat():
    rng = np.random.default_rng(3)
    rows, marks, packed = parts(60, 40, rng)
    ratios = rng.normal(size=1 << toxicity.HASH_BITS).astype(np.float32)
    weights, intercept = toxicity.logistic(packed, ratios, 0.0, 0.1)
    slope, shift = 0.1 * weights, 0.0
    for row, mark in zip(rows, marks):
        found, times = np.unique(row, return_counts=True)
        values = ratios[found] * np.log2(1 + times)
        miss = (1 / (1 + np.exp(-(values @ weights[found] + intercept))) - mark) / len(rows)
        slope[found] += miss * values
        shift += miss
    assert np.abs(slope).max() < 2e-3 and abs(shift) < 2e-3


def test_the_solver_holds_four_bytes_a_hash_and_single_precision_steps():
    rng = np.random.default_rng(4)
    rows, _, packed = parts(200, 4_000, rng)
    distinct = sum(len(np.unique(r)) for r in rows)
    assert sum(len(y) for x in packed[0][:3] for y in x) < 4.1 * distinct
    ratios = rng.normal(size=1 << toxicity.HASH_BITS).astype(np.float32)
    tracemalloc.start()
    toxicity.logistic(packed, ratios, 0.0, 1e-4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * (1 << toxicity.HASH_BITS) + 110_000_000
