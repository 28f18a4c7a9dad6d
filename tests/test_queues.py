"""Bounded queues against a plain simulation, as batch and stream; calls to a service that fails."""

import time

import numpy as np
from pyspark.sql import functions as F

from gridloom.streaming import enrich, queues
from gridloom.streaming.queues import FAN_OUT, JITTER, Policy, bounded_batch, bounded_stream, depths

EVENTS = "session long, ord long, kind string, branch string, frame long, n int"


def burst(sessions=3, n=400):
    """Bursts of offers with takes between; one branch is taken from far more seldom."""
    rng, rows = np.random.default_rng(1), []
    for s in range(sessions):
        for i in range(n):
            kind = rng.choice(["offer", "take"], p=[0.7, 0.3])
            branch = rng.choice(["fast", "slow"], p=[0.9, 0.1]) if kind == "take" else None
            rows.append((s, i, str(kind), None if branch is None else str(branch), i, int(rng.integers(1, 6))))
    return rows


def plain(rows, policy):
    out, held = [], {}
    for s, i, kind, branch, frame, n in sorted(rows, key=lambda r: r[:2]):
        for b in policy.branches if kind == "offer" else [branch or ""]:
            q = held.setdefault((s, b), [])
            if kind == "offer":
                q.append(frame)
                if len(q) > policy.capacity:
                    out.append((s, i, b, q.pop(0 if policy.oldest else -1), "dropped", len(q)))
            elif b in policy.branches:
                for _ in range(min(n, len(q))):
                    out.append((s, i, b, q.pop(0), "taken", len(q)))
    return sorted(out)


def test_batch_equals_a_plain_simulation(spark):
    rows = burst()
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    for policy in (Policy(7, ("fast", "slow"), oldest=False), Policy(7, ("fast", "slow")), Policy(0, ("fast",)), JITTER, FAN_OUT):
        assert sorted(map(tuple, bounded_batch(df, policy).collect())) == plain(rows, policy)
    both = {(r["session"], r["branch"]): r for r in depths(bounded_batch(df, Policy(7, ("fast", "slow"), oldest=False))).collect()}
    alone = {(r["session"], r["branch"]): r for r in depths(bounded_batch(df, Policy(7, ("fast",), oldest=False))).collect()}
    assert all(both[k] == alone[k] for k in alone) and both[0, "slow"]["dropped"] > both[0, "fast"]["dropped"]  # a slow branch costs the other nothing


def test_stream_equals_batch(spark, tmp_path):
    rows, policy = burst(2, 120), Policy(5, ("fast", "slow"), oldest=False)
    for lo in range(0, 120, 40):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 40], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = bounded_stream(stream, policy).writeStream.format("memory").queryName("queued").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(map(tuple, spark.table("queued").collect())) == plain(rows, policy)


def test_query_equals_a_plain_simulation(spark):
    from gridloom.plans import audio

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in audio.frame_events(spark, sf).collect()]
    got = {(r["session"], r["branch"]): (r["taken"], r["dropped"], r["deepest"]) for r in audio.bounded_queues(spark, sf).collect()}
    want = {}
    for s, _, b, _, what, depth in plain(rows, audio.POLICY):
        t, d, deep = want.get((s, b), (0, 0, 0))
        want[s, b] = (t + (what == "taken"), d + (what == "dropped"), max(deep, depth))
    assert got == want and sum(d for _, d, _ in got.values()) > 0


def logged(folder):
    """A service that fails by the text, and writes each call down."""

    def service(job, text):
        with open(f"{folder}/{job}", "a") as f:
            f.write("x")
        if text == "limit":
            raise enrich.ServiceError("RateLimited", 7.0)
        if text == "time":
            raise TimeoutError
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    return service


def test_calls_end_by_the_kind_of_error_and_are_not_repeated(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    jobs = spark.createDataFrame([("a", "fine"), ("b", "limit"), ("c", "time"), ("d", "bad"), ("e", " "), ("f", "x" * 9_000), ("a", "fine"), (None, "y")], "job string, text string")
    caps, folder = enrich.Caps(per_second=1_000.0, max_retries=2), str(tmp_path / "out")
    run = lambda now: {r["job"]: r for r in enrich.enrich(jobs, logged(tmp_path / "calls"), folder, now, caps, tasks=2).collect()}
    calls = lambda: {p.name: len(p.read_text()) for p in (tmp_path / "calls").iterdir()}
    got = run(0)
    assert {j: (r["state"], r["error"]) for j, r in got.items()} == {
        "a": ("Succeeded", None), "b": ("RetryScheduled", "RateLimited"), "c": ("RetryScheduled", "Timeout"), "d": ("FailedPermanent", "BadRequest"), "e": ("FailedPermanent", "BadRequest"), "f": ("FailedPermanent", "BadRequest"),
    }
    assert got["a"]["result"] == "FINE" and got["b"]["next_at"] == 7_000 and calls() == {"a": 1, "b": 1, "c": 1, "d": 1}
    run(500)  # nothing is due
    assert calls() == {"a": 1, "b": 1, "c": 1, "d": 1}
    got = run(7_000)
    assert calls() == {"a": 1, "b": 2, "c": 2, "d": 1} and got["b"]["attempts"] == 2
    got = run(10**6)
    assert (got["b"]["state"], got["b"]["attempts"]) == ("FailedPermanent", 3) and got["c"]["state"] == "FailedPermanent"
    run(10**9)
    assert calls() == {"a": 1, "b": 3, "c": 3, "d": 1}


def test_calls_are_paced_and_slow_ones_counted(spark):
    jobs = spark.createDataFrame([(str(i), "t", 0) for i in range(5)], "job string, text string, attempts int").coalesce(1)
    began = time.monotonic()
    assert enrich.call(jobs, enrich.stub, enrich.Caps(per_second=10.0)).where(F.col("result").startswith("[")).count() == 5
    assert time.monotonic() - began >= 0.4

    def slow(job, text):
        time.sleep(0.03)
        return text

    assert enrich.states(enrich.call(jobs, slow, enrich.Caps(per_second=100.0))).agg(F.sum("slow")).first()[0] == 5
