"""Captions over an audio buffer: any cut of the audio gives the same, as batch and as stream; every sample is accounted for."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.sources import messages
from gridloom.streaming.audio import LAST_POINT, LOUD, Buffer, Captioner, Options, captions_batch, captions_stream, heard, spoken, within

O = Options(rate=1_600)  # noqa: E741
W = 16
EPOCH_MS = 1_700_000_000_000
C = Captioner(heard(W), O)


def says(text):
    return np.repeat(np.array([0 if c.isspace() else min(ord(c), LAST_POINT) + LOUD for c in text], np.int16), W)


def run(chunks, captioner=C):
    b, out = Buffer(), []
    for at, pcm in chunks:
        out += captioner.accept(b, at, pcm) + captioner.settle(b)
    return out + captioner.end(b), b


def cut(pcm, places):
    places = [0, *sorted({p % (len(pcm) + 1) for p in places}), len(pcm)]
    return [(a, pcm[a:b]) for a, b in zip(places, places[1:])]


TEXT = "we start here and go on for a while." + " " * 200 + "yes" + " " * 200 + "no end mark " * 150 + " " * 90


def account(out):
    return json.loads([x for x in out if x[0] == "account"][-1][1])


def test_captions_close_by_silence_and_length():
    out, _ = run([(0, says(TEXT))])
    captions = [x for x in out if x[0] == "caption"]
    assert [x[4] for x in captions][:2] == ["Silence", "Silence"] and "MaxLength" in [x[4] for x in captions]
    assert " ".join(x[1] for x in captions).replace(" ", "") == "".join(TEXT.split())
    assert all(a[3] <= b[2] for a, b in zip(captions, captions[1:]))


def test_a_short_fragment_waits_for_half_a_second():
    out, _ = run([(0, says("hm" + " " * 300))])
    (caption,) = [x for x in out if x[0] == "caption"]
    assert caption[1] == "hm" and caption[3] == 1_600  # there is silence enough at 800 ms, the wait is over at 1600


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=40), st.randoms(use_true_random=False))
def test_any_cut_gives_the_same_and_no_sample_twice(places, random):
    pcm = says(TEXT)
    whole, _ = run([(0, pcm)])
    pieces = cut(pcm, places)
    assert run(pieces)[0] == whole
    again = [x for p in pieces for x in (p, p)]  # each chunk twice
    got, _ = run(again)
    assert [x for x in got if x[0] == "caption"] == [x for x in whole if x[0] == "caption"]
    a = account(got)
    assert a["repeated"] == len(pcm) and a["received"] + a["filled"] == a["finalised"] + a["discarded"] + a["pending"] == len(pcm)
    b, out = Buffer(), []
    random.shuffle(pieces)  # any order within one batch
    for at, x in pieces:
        out += C.accept(b, at, x)
    assert out + C.end(b) == whole


def test_a_gap_becomes_silence_after_the_jitter_bound():
    pcm = says("before the gap." + " " * 100)
    later = says("after the gap.")
    out, _ = run([(0, pcm), (len(pcm) + 800, later)])
    assert account(out)["filled"] == 800 and [x[1] for x in out if x[0] == "caption"] == ["before the gap.", "after the gap."]
    b = Buffer()
    C.accept(b, len(pcm) + 800, says("x" * 200))
    assert C.settle(b) != [] or b.position == len(pcm) + 800 + 3_200
    assert C.accept(b, 0, pcm) == [] and b.account.repeated == len(pcm)  # too late by then


def test_a_silent_buffer_shrinks_at_twelve_seconds():
    b = Buffer()
    most = O.samples(12_000)
    C.accept(b, 0, np.zeros(most - 1, np.int16))
    assert sum(map(len, b.blocks)) == most - 1
    assert C.accept(b, most - 1, np.zeros(1, np.int16)) == []
    assert b.blocks == [] and b.start == O.samples(12_000) and b.account.finalised == O.samples(12_000)


def test_a_tail_under_a_tenth_of_a_second_is_counted():
    out, b = run([(0, says("a text of more. " + " " * 144 + "x" * 9))])
    assert account(out)["discarded"] == O.samples(90) and b.position == b.start
    assert account(run([(0, says("x" * 10))])[0])["discarded"] == 0


def test_silent_text_is_not_said():
    quiet = Captioner(lambda samples: "thank you for watching.", O)
    out, _ = run([(0, np.ones(O.samples(5_000), np.int16))], quiet)
    a = account(out)
    assert [x[0] for x in out] == ["account"] and a["suppressed"] >= 1 and a["finalised"] == O.samples(5_000)


def test_the_last_recognition_is_bounded():
    def slow(samples):
        if len(samples) % O.samples(O.interval_ms):
            time.sleep(5)
        return heard(W)(samples)

    bounded = Captioner(slow, Options(rate=1_600, last_s=0.2))
    out, _ = run([(0, says("what is stable stays so" + "x" * 150))], bounded)
    a = account(out)
    assert a["pending"] == len(says("what is stable stays so" + "x" * 150)) and [x[4] for x in out][:-1] == ["Flush"]

    def broken():
        raise RuntimeError

    assert within(5, broken) is None


def test_options_are_checked():
    for wrong in ({"interval_ms": 400}, {"interval_ms": 1_100}, {"interval_ms": 805}, {"rate": 1_234}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_state_survives_being_written():
    b = Buffer()
    C.accept(b, 0, says(TEXT)[:9_999])
    again = Buffer.loads(b.dumps())
    again.blocks = b.blocks
    assert vars(again) == vars(b)


def test_spoken_is_heard(spark):
    (row,) = spark.range(1).select(spoken(F.lit("a b\n中, c."), W).alias("pcm")).collect()
    assert heard(W)(np.frombuffer(row["pcm"], "<i2")) == "a b 中, c."


def wav_table(spark, folder):
    """Three sessions as WAV files, one cut into many."""
    texts = {1: TEXT, 2: "hm", 3: "one. " + " " * 1_300 + "two words follow" + " " * 40}
    for session, text in texts.items():
        pcm = says(text)
        for n, (at, part) in enumerate(cut(pcm, range(0, len(pcm), 3_333) if session == 1 else [])):
            (folder / f"{session}-{at:09d}.wav").write_bytes(messages.wav_bytes(part.tobytes(), O.rate))
    return texts


def test_stream_equals_batch_over_wav_chunks(spark, tmp_path):
    wavs = tmp_path / "wavs"
    wavs.mkdir()
    texts = wav_table(spark, wavs)
    rows = messages.wav(spark, str(wavs), most=1_000, rate=O.rate)
    name = F.regexp_extract("path", r"(\d+)-(\d+)\.wav$", 1).cast("long"), F.regexp_extract("path", r"(\d+)-(\d+)\.wav$", 2).cast("long")
    at = (name[1] + F.round(F.col("start_s") * O.rate)).cast("long")
    chunks = rows.select(name[0].alias("session"), at.alias("at"), F.col("data").alias("pcm"))
    batch = sorted(map(tuple, captions_batch(chunks, heard(W), O).collect()), key=str)
    assert {x[0] for x in batch} == set(texts)
    source = tmp_path / "chunks"
    timed = chunks.withColumn("ts", F.timestamp_millis((EPOCH_MS + F.col("at") * 1_000 / O.rate).cast("long"))).withColumn("ended", F.lit(False))
    order = timed.orderBy("ts", "session").collect()
    for i in range(0, len(order), 40):
        spark.createDataFrame(order[i : i + 40], timed.schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    last = [(s, None, None, 0, True) for s in texts]
    spark.createDataFrame(last, "session long, at long, pcm binary, ts long, ended boolean").withColumn("ts", F.timestamp_millis(F.lit(EPOCH_MS + 3_600_000))).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = captions_stream(stream, heard(W), O).writeStream.format("memory").queryName("audio_said").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted(map(tuple, spark.table("audio_said").collect()), key=str)
    assert [x for x in got if x[1] == "caption"] == [x for x in batch if x[1] == "caption"]
    assert {(x[0], x[1]) for x in got} == {(x[0], x[1]) for x in batch}


def test_a_timer_ends_an_idle_session(spark, tmp_path):
    """The second session's later event time moves the watermark beyond the first one's timer."""
    path = str(tmp_path / "in")
    schema = "session long, at long, pcm binary, ts timestamp, ended boolean"
    for session, second in ((1, 10), (2, 3_600), (2, 3_601)):
        rows = [(session, 0, says("hello there. " * 3).tobytes())]
        spark.createDataFrame(rows, "session long, at long, pcm binary").withColumn("ts", F.timestamp_seconds(F.lit(second))).withColumn("ended", F.lit(False)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = captions_stream(stream, heard(W), O).writeStream.format("memory").queryName("audio_idle").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["session"], r["kind"], r["text"]) for r in spark.table("audio_idle").collect()]
    assert (1, "account") in {x[:2] for x in got} and (2, "account") not in {x[:2] for x in got}
    assert (1, "caption", " ".join(["hello there."] * 3)) in got


def test_query_equals_a_plain_run(spark):
    from gridloom.plans import audio as plans

    sf = "/root/testdata/sf0.001"
    sessions: dict[int, list] = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        sessions.setdefault(r["conv_id"], []).append((r["text"] or "") + plans.PAUSE)
    want = []
    for s, texts in sessions.items():
        want += [(s, *x) for x in run([(0, says("".join(texts)))], Captioner(heard(plans.WINDOW), plans.OPTIONS))[0]]
    got = map(tuple, plans.audio_captions(spark, sf).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
