"""The transcript store: tables change together, writers don't lose each other's rows, and a batch writes its own rows."""

import pytest

from gridloom.schemas import SEGMENTS, SESSIONS
from gridloom.streaming.store import Conflict, Store


def store_at(spark, path, **more):
    return Store(spark, str(path), {"sessions": SESSIONS, "segments": SEGMENTS}, buckets=2, **more)


def batch(spark, *rows):
    """(session, id, text) as final segments in order."""
    return spark.createDataFrame([(s, None, i, t, None, "Final", 0, 1, n) for n, (s, i, t) in enumerate(rows)], f"{SEGMENTS}, ord long").coalesce(1)


def sessions(spark, *ids):
    return spark.createDataFrame([(i, "Running", 0, "ja") for i in ids], SESSIONS).coalesce(1)


def texts(store, version=None):
    return {(r["session"], r["id"]): (r["seq"], r["text"]) for r in store.read("segments", version).collect()}


def test_versions_are_whole(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.read("segments").count() == 0 and store.versions() == []
    one = store.change(lambda t: (t.create_sessions(sessions(spark, 1, 2)), t.upsert_segments(batch(spark, (1, "a", "x"), (2, "b", "y")), "ord")))
    store.upsert_segments(batch(spark, (1, "a", "X"), (1, "c", "z")), "ord")
    assert texts(store) == {(1, "a"): (1, "X"), (1, "c"): (2, "z"), (2, "b"): (1, "y")}
    assert one == 1 and texts(store, 1) == {(1, "a"): (1, "x"), (2, "b"): (1, "y")}


def test_a_crash_between_tables_leaves_the_state_before(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    store.change(lambda t: (t.create_sessions(sessions(spark, 1)), t.upsert_segments(batch(spark, (1, "a", "x")), "ord")))
    written = Store._written

    def dying(self, manifest, table, rows, version):
        if table == "sessions":
            raise RuntimeError("killed")
        return written(self, manifest, table, rows, version)

    monkeypatch.setattr(Store, "_written", dying)
    with pytest.raises(RuntimeError, match="killed"):
        store.change(lambda t: (t.upsert_segments(batch(spark, (1, "a", "new"), (2, "b", "new")), "ord"), t.create_sessions(sessions(spark, 2))))
    monkeypatch.undo()
    again = store_at(spark, tmp_path)
    assert texts(again) == {(1, "a"): (1, "x")} and [r["session"] for r in again.read("sessions").collect()] == [1]
    store.delete(sessions(spark, 1))
    assert texts(again) == {} and again.read("sessions").count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    store, other = store_at(spark, tmp_path), store_at(spark, tmp_path)
    turns = []

    def slow(t):
        if not turns:  # the other one publishes while this one is at work
            other.upsert_segments(batch(spark, (1, "o", "other")), "ord")
        turns.append(t.before["version"])
        t.upsert_segments(batch(spark, (1, "m", "mine")), "ord")

    store.change(slow)
    assert turns == [0, 1] and texts(store) == {(1, "o"): (1, "other"), (1, "m"): (2, "mine")}

    def never(t):
        other.upsert_segments(batch(spark, (1, "o", "again")), "ord")
        t.upsert_segments(batch(spark, (1, "m", "lost")), "ord")

    import gridloom.streaming.store as module

    before, module.ATTEMPTS = module.ATTEMPTS, 1
    try:
        with pytest.raises(Conflict):
            store.change(never)
    finally:
        module.ATTEMPTS = before
    assert texts(store)[1, "m"] == (2, "mine")


def test_batches_write_their_own_rows_and_runs_are_merged(spark, tmp_path, monkeypatch):
    """Over twelve equal batches each row is written about log2 times, and few folders are left to read."""
    store, rows = store_at(spark, tmp_path), []
    written = Store._written

    def counting(self, manifest, table, df, version):
        out = written(self, manifest, table, df, version)
        rows.append(sum(x[2] for x in out.values()))
        return out

    monkeypatch.setattr(Store, "_written", counting)
    for n in range(12):
        store.upsert_segments(batch(spark, *[(s, f"{n}", f"t{n}") for s in range(4)]), "ord")
    assert sum(rows) <= 48 * (1 + 4) and rows.count(4) >= 12
    layers = [len(x) for x in store.manifest()["tables"]["segments"].values()]
    assert max(layers) <= 4
    assert texts(store) == {(s, f"{n}"): (n + 1, f"t{n}") for s in range(4) for n in range(12)}
    gone = store.vacuum()
    assert gone > 0 and store.vacuum() == 0 and len(texts(store)) == 48 and len(store.versions()) == 2


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    sink = store.sink("ord")
    sink(batch(spark, (1, "a", "x")), 0)
    sink(batch(spark, (1, "a", "y"), (1, "b", "y")), 1)
    version = store.versions()[-1]
    sink(batch(spark, (1, "a", "x")), 0)
    assert texts(store) == {(1, "a"): (1, "y"), (1, "b"): (2, "y")} and store.versions()[-1] == version
