"""Prefix trie, vector codes and language mixtures against plain versions and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import language_mix, prefix_trie, queries, vector_codes
from gridloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def equals_oracle(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.select(*columns).fetchall())) and rows


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes"])
def test_query_equals_oracle(spark, name):
    equals_oracle(spark, name)


# 11: prefix trie.


def base_of(c):
    return c - (c % 20 if c >= 0 else -(-c % 20))


def plain_trie(rows):
    """rows (conv_id, turn, role, text) with distinct turns in a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(base_of(c), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    out = {}
    for node, found in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in below if m)
        ends = hashlib.sha256(",".join(str(c) for c, last in sorted(found) if last).encode()).hexdigest()
        children = sum(len(m) == len(node) + 1 for m in below)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out[min(c for c, _ in found), len(node)] = (parent, len(found), children, leaves, saved, ends)
    return out


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in prefix_trie.prefix_trie(df).collect()}


def test_trie_equals_a_plain_version(spark):
    """Few texts, so that families share prefixes; conversations without a base, of one turn, with null turns, roles and texts; ids below 0."""
    rng = np.random.default_rng(3)
    rows = []
    for c in {*rng.choice(600, 140, replace=False).tolist(), *range(-45, 45, 3), 2**62, 2**62 + 3}:
        for t in range(int(rng.integers(1, 7))):
            role, text = rng.choice(["user", "assistant", None], p=[0.8, 0.1, 0.1]), rng.choice(["a b", "c", "", None], p=[0.7, 0.1, 0.1, 0.1])
            rows.append((int(c), t if t or rng.random() < 0.9 else None, role, text))
    rows.append((None, 0, "user", "no conversation"))
    got = trie(spark, rows)
    assert got == plain_trie(rows)
    assert any(k[1] > 0 and v[1] > 20 for k, v in got.items())


def test_trie_broadcasts_no_more_nodes_than_proven(spark, monkeypatch):
    """With a small bound hot and other nodes are joined in both ways; the result is the same."""
    rows = [(c, t, "user", "same") for c in range(0, 900, 7) for t in range(3)] + [(c, t, "user", f"own {c}") for c in range(0, 900, 11) for t in range(3, 5)]
    want = plain_trie(rows)
    for most in (1, 5, 10**6):
        monkeypatch.setattr(prefix_trie, "HOT", most)
        assert trie(spark, rows) == want


def test_trie_digests_cross_batches_and_chunks(spark, monkeypatch):
    """Many conversations end at one node: its ids are read in chunks, ascending, over several batches."""
    rows = [(c, 0, "user", "same") for c in range(-50, 5_000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    try:
        got = trie(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    turnless = [c for c in range(-50, 5_000) if zlib.crc32(str(c).encode()) % 4 and not -50 <= base_of(c) < 5_000]
    assert got[-50, 0][5] == digest(turnless) and got[min(c for c in range(-50, 5_000) if c not in turnless), 1][5] == digest([c for c in range(-50, 5_000) if c not in turnless])


def test_trie_ties_repeats_and_extra_columns(spark):
    """Equal turns have one order whatever the input's; repeated rows are turns; clashing columns are not read."""
    rows = [(1, 0, "user", "x"), (1, 0, "user", "y"), (1, 0, "user", "y"), (1, 1, "user", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = df.withColumns({c: F.lit(1) for c in ("family", "key", "depth", "digest", "words", "ends", "top", "n_convs")})
    a, b = ({tuple(r) for r in prefix_trie.prefix_trie(x).collect()} for x in (df, more.orderBy(F.desc("text")).coalesce(1)))
    assert a == b and max(r[1] for r in a) == 4 - prefix_trie.opening(1)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0
    assert trie(spark, [(None, 1, "user", "x")]) == {}


# 12: vector codes.


def plain_codes(rows, rounds=4):
    rows = [(i, label, [math.floor(1024 * float(x)) for x in v]) for i, label, v in rows]
    w = len(rows[0][2]) if rows else 0
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(w), 4))])
    parts = [[v[a:b] for _, _, v in rows] for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][2]))
    books = [[list(p[i]) for i in order[:256]] for p in parts]
    near = lambda p, book: min((sum((x - y) ** 2 for x, y in zip(p, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in zip(parts, books):
            groups = defaultdict(list)
            for v in p:
                groups[near(v, book)[1]].append(v)
            for j, g in groups.items():
                book[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [[near(v, book) for v in p] for p, book in zip(parts, books)]
    errors = [sum(f[i][0] for f in found) for i in range(len(rows))]
    totals = defaultdict(int)
    for (_, label, _), e in zip(rows, errors):
        totals[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{f[n][1]:02x}" for f in found), errors[n], totals[label], sha) for n, (i, label, _) in enumerate(rows))


def codes(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3)
    return sorted(tuple(r) for r in vector_codes.compress(df).drop("label").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_equal_a_plain_version(spark):
    """More rows than entries, many of them equal, labels with nulls, and a width that four does not divide."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 5 == 0 else i % 3, [float(x) for x in rng.integers(-3, 4, 6) / 512]) for i in range(400)]
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_of_large_components_are_exact(spark):
    rows = [(i, 0, [float(10.0**12 + i * 3), -1e15, 2.5, i / 7]) for i in range(40)]
    got = codes(spark, rows)
    want = plain_codes(rows)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[4] for x in got] == [x[4] for x in want]
    assert [x[2] for x in got] == [min(x[2], vector_codes.MOST) for x in want]


def test_codes_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, 1, [0.5, 0.25, -0.5, 1.0]), (2, None, [0.0, 0.0, 0.0, 0.0]), (2, None, [0.0, 0.0, 0.0, 0.0]), (None, 1, [0.5, 0.25, -0.5, 1.0])]
    bad = [(3, 1, None), (4, 1, [1.0, None, 0.0, 0.0]), (5, 1, [nan, 0.0, 0.0, 0.0]), (6, 1, [inf, 0.0, 0.0, 0.0]), (7, 1, [-inf, 0.0, 0.0, 0.0]), (8, 1, [1e300, 0.0, 0.0, 0.0]), (9, 1, [1.0, 2.0]), (10, 1, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("mine") for c in ("vector", "code", "of", "error", "width")})
    rows = vector_codes.compress(df).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in rows) == [(0, "00000000", 0, 0), (1, "00000000", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0)]
    assert vector_codes.compress(df.where("false")).count() == 0
    (empty,) = vector_codes.compress(spark.createDataFrame([(1, 1, [])], "vec_id long, label int, embedding array<double>")).collect()
    assert (empty["code"], empty["error"], empty["codebooks_sha256"]) == ("00000000", 0, hashlib.sha256(b"").hexdigest())


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 25), st.integers(0, 2**32 - 1))
def test_intervals_hold_the_exact_scores(width, bits, seed):
    """Integers up to 2**25, where single precision rounds: every exact score lies in its interval, and the choice is the exact one."""
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-(2**bits), 2**bits + 1, (30, width)), rng.integers(-(2**bits), 2**bits + 1, (20, width))
    book[7] = book[3]
    points[0] = book[3]
    score, radius = vector_codes.intervals(points, book)
    exact = ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(-1)
    twice = exact - (points.astype(object) ** 2).sum(-1)[:, None]  # 2 (|e|^2 / 2 - p.e)
    assert all(abs(int(t) / 2 - s) <= r * (1 + 1e-9) + 1e-9 for t, s, r in zip(twice.ravel(), score.ravel(), radius.ravel()))
    index, distance = vector_codes.nearest(points, book)
    assert index.tolist() == [min((d, j) for j, d in enumerate(row))[1] for row in exact] and distance.tolist() == [min(row) for row in exact]


# 13: language mixtures.


def test_grams_equal_a_plain_version():
    texts = ["Ab c", "", "x1y", "éÉ  ü", "one two", "ab c"]
    owner, bucket, count = language_mix.grams(texts)

    def plain(text):
        out = defaultdict(int)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            for n in language_mix.ORDERS:
                for i in range(len(padded) - n + 1):
                    gram = padded[i : i + n]
                    if gram.strip():
                        out[gram] += 1
        return out

    for i, text in enumerate(texts):
        assert sorted(count[owner == i]) == sorted(plain(text).values())
    same = lambda i: sorted(zip(bucket[owner == i], count[owner == i]))
    assert same(0) == same(5) and same(0) != same(4)


def test_counts_equal_a_plain_count(spark):
    rows = [("aa", "xy"), ("bb aa", "xy"), ("aa", "zz"), (None, "xy"), ("aa", None)]
    model = language_mix.fit(spark.createDataFrame(rows, "text string, lang string"))
    want = {lang: np.zeros(language_mix.BUCKETS) for lang in ("xy", "zz")}
    for text, lang in rows:
        if text and lang:
            _, bucket, count = language_mix.grams([text])
            np.add.at(want[lang], bucket, count)
    assert model.languages == ["xy", "zz"]
    assert np.allclose(model.likely, language_mix.model_of(want).likely) and np.allclose(model.likely.sum(0, dtype=np.float64), 1, atol=1e-5)


def test_mixtures_are_told(spark):
    """A text of two languages has both, in about their shares; a word of another one is none."""
    rng = np.random.default_rng(2)
    sounds = {"la": ["ka", "ke", "ko"], "lb": ["mi", "mu", "ma"], "lc": ["zor", "zar", "zer"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(n))
    model = language_mix.fit(spark.createDataFrame([(say(lang, 60), lang) for lang in sounds for _ in range(20)], "text string, lang string"))
    shares = language_mix.proportions([f"{say('la', 60)} {say('lb', 30)}", f"{say('lc', 90)} {say('la', 1)}", say("lb", 40)], model)
    assert shares[0][2] == 0 and abs(shares[0][0] - 2 / 3) < 0.05 and np.count_nonzero(shares[1]) == 1 == np.count_nonzero(shares[2])
    assert np.allclose(shares.sum(1), 1, atol=1e-5)


def test_blocks_do_not_change_the_result(spark):
    docs = [r["text"] or "" for r in table(spark, SF, "documents").limit(60).collect()]
    model = language_mix.fit(table(spark, SF, "documents"))
    whole = language_mix.proportions(docs, model)
    assert np.allclose(whole, np.concatenate([language_mix.proportions([t], model) for t in docs]), atol=1e-4)


def test_held_out_languages(spark):
    """All but 2 % of the held-out rows at least get their language; the model saw none of them."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op13_language_mix(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_languages_come_from_the_training_fold_only(spark):
    docs = spark.createDataFrame([(i, "same text here", "in" if zlib.crc32(str(i).encode()) % 4 != 2 else "out") for i in range(60)], "doc_id long, text string, lang string")
    model = language_mix.fit(docs.where(~language_mix.held_out(F.col("doc_id"))))
    assert model.languages == ["in"]


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... \n", "en"), (4, "the text " * 50_000, "en"), (5, "der Text", "de"), (5, "der Text", "de"), (None, "das", None), (6, "́", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "lang_mix", "bucket", "n", "_mix")})
    model = language_mix.fit(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["_mix"], r["lang_mix"]) for r in language_mix.predict(docs, model).collect()]
    assert {x[:3] for x in got if x[0] in (1, 2, 3, 6)} == {(i, "und", 0.0) for i in (1, 2, 3, 6)} and all(x[3] == "mine" for x in got)
    assert [x[1] for x in got if x[0] == 5] == ["de", "de"] and [x[1] for x in got if x[0] == 4] == ["en"] and len(got) == len(rows)
    assert all(0 <= x[2] <= 1 and isinstance(x[4], dict) for x in got)
    assert language_mix.predict(docs.where("false"), model).count() == 0
    nothing = language_mix.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language_mix.predict(docs, nothing).collect()} == {"und"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_mix, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_mix.fit(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"))


def test_many_languages_in_one_task(spark):
    """More languages than a task holds at once are handed on in parts."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"l{i % 70}" for i in range(140)]), pa.array([f"word{i}" for i in range(140)])], names=["lang", "text"])
    counts = defaultdict(int)
    for part in language_mix._counted(iter([batch, batch])):
        for r in part.to_pylist():
            counts[r["lang"]] += r["n"]
    assert len(counts) == 70 and sum(counts.values()) == 2 * sum(int(language_mix.grams([f"word{i}"])[2].sum()) for i in range(140))
