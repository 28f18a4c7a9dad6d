"""Which arrays of ids are copied when sequences are cut."""

from gridloom.llm import packing


def test_whole_arrays_are_not_sliced_and_long_ones_are(spark):
    sizes = [0, 1, 7, 8, 9, 16, 17, None]
    docs = spark.createDataFrame([(i, None if n is None else list(range(n))) for i, n in enumerate(sizes)], "doc_id long, ids array<int>")
    rows = packing.cut(docs, "ids", 8)
    got = sorted((r["doc_id"], r["part"], r["start"], r["tokens"], tuple(r["ids"])) for r in rows.collect())
    want = [(i, p, 8 * p, len(own), own) for i, n in enumerate(sizes) for p in range(max(1, -(-(n or 0) // 8))) for own in [tuple(range(n or 0))[8 * p : 8 * p + 8]]]
    assert got == want
    assert "<= 8) THEN array(struct(part, 0" in rows._jdf.queryExecution().analyzed().toString()
