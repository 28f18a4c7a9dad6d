"""Positions of a playback: before the start, without a time, between captions that begin together."""

import duckdb

from gridloom.plans.registry import ORACLES, QUERIES


def test_short_empty_and_null_texts_as_in_sql(spark, tmp_path):
    texts = {
        0: ["short", "a", "and then a longer one"],  # ends 450 ms before the first position that isn't negative
        1: ["", "", "three begin together, at zero"],
        2: [None, None, "two without an end", None],
        3: ["x" * 80_000, "beyond an hour"],
        None: ["no session, no caption, though it is long enough", "neither"],
    }
    rows = [(conv, turn, "user", text) for conv, said in texts.items() for turn, text in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["playback_asof"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE)")
    want = con.sql(ORACLES["playback_asof"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert (0, -450, -1, "00:00") in want and any(at is None for *_, at in want)
