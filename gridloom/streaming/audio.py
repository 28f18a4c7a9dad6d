"""Captions over a keyed audio buffer: one state machine for batch and stream.

A session's buffer holds the samples of the utterance that is being spoken. Every
interval of the sample clock the whole buffer is recognised, the text is stabilised
and may close; then exactly the recognised samples leave the buffer, and what came
after them starts the next utterance. Loudness is measured over windows that are
aligned to the sample clock, and chunks are cut at the ticks of that clock, so the
captions do not depend on how the audio was cut or batched.

Chunks name the position of their first sample. What was already taken is cut off, a
chunk beyond the next position waits for the gap to close, and a gap older than the
jitter bound, or one at the end, is filled with silence; all is counted.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.folds import folded
from gridloom.operators.signals import SILENCE
from gridloom.streaming.captions import LAST_TEXTS, Stabiliser, advance, ends_sentence, flush, holds, reason

Recogniser = Callable[[np.ndarray], str]

#: kind is caption, or account: the counts of an ended session, as JSON in text.
OUTPUT = "session long, kind string, text string, start_ms long, end_ms long, reason string"


@dataclass(frozen=True)
class Options:
    rate: int = 16_000
    #: Time between two recognitions, 500 to 1000 ms.
    interval_ms: int = 800
    window_ms: int = 10
    threshold: float = SILENCE
    #: A buffer without a loud window and without text is given up at this length or this wait.
    max_ms: int = 12_000
    wait_ms: int = 20_000
    #: Less than this at the end is not recognised.
    least_ms: int = 100
    #: A gap waits for so much later audio.
    jitter_ms: int = 1_000
    #: The last recognition of a session may take so long.
    last_s: float = 5.0
    #: A session without audio for so long (event time) has ended.
    idle_ms: int = 30_000

    def __post_init__(self):
        if not 500 <= self.interval_ms <= 1_000 or self.interval_ms % self.window_ms or self.rate * self.window_ms % 1_000:
            raise ValueError("interval_ms is 500 to 1000 and a multiple of window_ms, which is a whole number of samples")

    def samples(self, ms: int) -> int:
        return ms * self.rate // 1_000

    def ms(self, samples: int) -> int:
        return samples * 1_000 // self.rate


@dataclass
class Account:
    """Samples and recognitions of a session; received + filled = finalised + discarded + pending."""

    received: int = 0
    repeated: int = 0
    filled: int = 0
    finalised: int = 0
    discarded: int = 0
    pending: int = 0
    recognitions: int = 0
    empty: int = 0
    suppressed: int = 0
    captions: int = 0


def within(seconds: float, work: Callable[[], str]) -> str | None:
    """What work gives, or None if it fails or takes longer."""
    got: list[str] = []
    thread = threading.Thread(target=lambda: got.append(work()), daemon=True)
    hook, threading.excepthook = threading.excepthook, lambda _: None
    try:
        thread.start()
        thread.join(seconds)
    finally:
        threading.excepthook = hook
    return got[0] if got else None


@dataclass
class Buffer:
    """The state of one session. blocks hold the samples from start to position; ahead the chunks that came too early."""

    stabiliser: Stabiliser = field(default_factory=Stabiliser)
    position: int = 0
    start: int = 0
    waits_since: int = 0
    measured: int = 0
    quiet: int = 0
    loud: bool = False
    unchanged: int = 0
    held_since: int | None = None
    last_end: int = 0
    account: Account = field(default_factory=Account)
    blocks: list[np.ndarray] = field(default_factory=list)
    ahead: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def dumps(self) -> str:
        """All but the samples."""
        return json.dumps({k: asdict(v) if k in ("stabiliser", "account") else v for k, v in vars(self).items() if k not in ("blocks", "ahead")})

    @staticmethod
    def loads(text: str) -> Buffer:
        raw = json.loads(text)
        return Buffer(**{**raw, "stabiliser": Stabiliser(**raw["stabiliser"]), "account": Account(**raw["account"])})


@dataclass(frozen=True)
class Captioner:
    recognise: Recogniser
    options: Options = Options()

    def accept(self, b: Buffer, at: int, pcm: np.ndarray) -> list[tuple]:
        """One more chunk; captions that close on the way."""
        repeated = min(max(b.position - at, 0), len(pcm))
        b.account.repeated += repeated
        at, pcm = at + repeated, pcm[repeated:]
        if len(pcm):
            b.ahead.append((at, pcm))
        return self._due(b)

    def settle(self, b: Buffer) -> list[tuple]:
        """Gaps that later audio has waited for long enough become silence."""
        out = []
        while b.ahead and max(at + len(pcm) for at, pcm in b.ahead) - b.position > self.options.samples(self.options.jitter_ms):
            out += self._filled(b)
        return out

    def end(self, b: Buffer) -> list[tuple]:
        """The end of a session's input: one last, bounded recognition, and the account.

        Less than least_ms is discarded. Where the recogniser fails or takes too long,
        the samples stay pending and what was stable before is the caption.
        """
        out = []
        while b.ahead:
            out += self._filled(b)
        left = self._samples(b)
        self._measure(b, left)
        if len(left) < self.options.samples(self.options.least_ms):
            b.account.discarded += len(left)
            out += self._said(b, "Flush")
            self._next(b)
        else:
            text = within(self.options.last_s, lambda: self.recognise(left))
            b.account.recognitions += 1
            if text is None:
                out += self._said(b, "Flush")
                b.account.pending += len(left)
            else:
                b.stabiliser = advance(b.stabiliser, text, LAST_TEXTS)
                out += self._said(b, "Flush")
                b.account.finalised += len(left)
            self._next(b)
        return [*out, ("account", json.dumps(asdict(b.account)), 0, self.options.ms(b.position), None)]

    def _due(self, b: Buffer) -> list[tuple]:
        out = []
        while ready := [i for i, (at, _) in enumerate(b.ahead) if at <= b.position]:
            at, pcm = b.ahead.pop(ready[0])
            seen = min(b.position - at, len(pcm))
            b.account.repeated += seen
            b.account.received += len(pcm) - seen
            out += self._feed(b, pcm[seen:])
        return out

    def _filled(self, b: Buffer) -> list[tuple]:
        gap = min(at for at, _ in b.ahead) - b.position
        b.account.filled += gap
        return self._feed(b, np.zeros(gap, np.int16)) + self._due(b)

    def _feed(self, b: Buffer, pcm: np.ndarray) -> list[tuple]:
        out, step = [], self.options.samples(self.options.interval_ms)
        while len(pcm):
            n = min(len(pcm), step - b.position % step)
            b.blocks.append(pcm[:n])
            b.position += n
            pcm = pcm[n:]
            if b.position % step == 0:
                out += self._cycle(b)
        return out

    @staticmethod
    def _samples(b: Buffer) -> np.ndarray:
        return np.concatenate(b.blocks) if b.blocks else np.zeros(0, np.int16)

    def _measure(self, b: Buffer, samples: np.ndarray) -> None:
        """Loudness of the windows that are whole by now and were not before."""
        window = self.options.samples(self.options.window_ms)
        new = samples[b.measured - b.start :]
        new = new[: len(new) // window * window].reshape(-1, window)
        level = new.astype(np.float64)
        loud = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", level, level) / window) / 32768.0 >= self.options.threshold)  # sums of whole squares are exact
        b.measured += new.size
        b.loud |= bool(len(loud))
        b.quiet = b.quiet + new.size if not len(loud) else (len(new) - 1 - int(loud[-1])) * window

    def _cycle(self, b: Buffer) -> list[tuple]:
        o, samples = self.options, self._samples(b)
        self._measure(b, samples)
        text = self.recognise(samples)
        b.account.recognitions += 1
        b.account.empty += not text.strip()
        before = b.stabiliser.committed
        b.stabiliser = advance(b.stabiliser, text, LAST_TEXTS)
        b.unchanged = b.unchanged + 1 if b.stabiliser.committed == before else 0
        said = b.stabiliser.committed or b.stabiliser.partial
        length, waited, now = o.ms(len(samples)), o.ms(b.position - b.waits_since), o.ms(b.position)
        why = reason(said.strip(), False, length, waited, o.ms(b.quiet), b.unchanged)
        if why is None:
            if not said.strip() and not b.loud and (length >= o.max_ms or waited >= o.wait_ms):
                b.account.finalised += len(samples)
                self._next(b)
            return []
        held, b.held_since = holds(why, said, now, b.held_since)
        if held:
            return []
        out = self._said(b, why)
        b.account.finalised += len(samples)
        self._next(b)
        return out

    def _said(self, b: Buffer, why: str) -> list[tuple]:
        """The caption of the buffer; none from a buffer without any loud window."""
        text = flush(b.stabiliser)
        if not text:
            return []
        if not b.loud:
            b.account.suppressed += 1
            return []
        begin = max(self.options.ms(b.start), b.last_end)
        b.last_end = max(self.options.ms(b.position), begin)
        b.account.captions += 1
        return [("caption", text, begin, b.last_end, why)]

    @staticmethod
    def _next(b: Buffer) -> None:
        """The samples of the buffer leave it; the next utterance starts where they end."""
        b.stabiliser, b.blocks, b.loud, b.quiet, b.unchanged, b.held_since = Stabiliser(), [], False, 0, 0, None
        b.start = b.waits_since = b.measured = b.position


def pcm_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def captions_batch(chunks: DataFrame, recognise: Recogniser, options: Options = Options()) -> DataFrame:
    """Captions and accounts of whole sessions of chunks (session, at, pcm): at is the first sample's position, pcm 16-bit mono.

    Null or empty pcm counts as no chunk, a null at too. A session is one fold in
    order; a task holds one buffer and one batch of rows.
    """
    captioner = Captioner(recognise, options)

    def fold(b: Buffer, row: dict):
        out = captioner.accept(b, int(row["at"]), pcm_of(row["pcm"]))
        return b, out + captioner.settle(b)

    rows = chunks.where(F.col("at").isNotNull() & (F.octet_length("pcm") > 1)).select("session", "at", "pcm")
    return folded(rows, "at", Buffer, fold, OUTPUT, captioner.end)


class AudioProcessor(StatefulProcessor):
    """The same over a stream: small values in one state, samples as blocks in two list states.

    A batch adds its blocks; only a caption, which empties the buffer, rewrites them.
    A timer of event time ends a session that stays silent for idle_ms.
    """

    def __init__(self, captioner: Captioner):
        self.captioner = captioner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.small = handle.getValueState("buffer", "json string")
        self.blocks = handle.getListState("blocks", "pcm binary")
        self.ahead = handle.getListState("ahead", "at long, pcm binary")

    def _read(self) -> Buffer:
        b = Buffer.loads(self.small.get()[0]) if self.small.exists() else Buffer()
        b.blocks = [pcm_of(x[0]) for x in self.blocks.get()] if self.blocks.exists() else []
        b.ahead = [(int(x[0]), pcm_of(x[1])) for x in self.ahead.get()] if self.ahead.exists() else []
        return b

    def _write(self, b: Buffer, start: int, blocks: int) -> None:
        """Blocks are added if the utterance is still the same, else replaced."""
        self.small.update((b.dumps(),))
        if b.start != start:
            self.blocks.clear()
            blocks = 0
        if len(b.blocks) > blocks:
            self.blocks.appendList([(x.tobytes(),) for x in b.blocks[blocks:]])
        self.ahead.clear()
        if b.ahead:
            self.ahead.put([(at, pcm.tobytes()) for at, pcm in b.ahead])

    @staticmethod
    def _told(session, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(session, *x) for x in rows], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = self._read()
        start, blocks, out, last, ended = b.start, len(b.blocks), [], None, False
        for frame in rows:
            for at, pcm, ts, ends in zip(frame["at"], frame["pcm"], frame["ts"], frame["ended"]):
                last = ts if last is None or ts > last else last
                ended |= bool(ends)
                if pcm is not None and len(pcm) > 1 and not pd.isna(at):
                    out += self.captioner.accept(b, int(at), pcm_of(pcm))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if ended:
            out += self.captioner.end(b)
            self._forget()
        else:
            out += self.captioner.settle(b)
            self._write(b, start, blocks)
            self.handle.registerTimer(int(last.timestamp() * 1_000) + self.captioner.options.idle_ms)
        yield self._told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.captioner.end(self._read())
        self._forget()
        yield self._told(key[0], out)

    def _forget(self) -> None:
        for state in (self.small, self.blocks, self.ahead):
            state.clear()

    def close(self) -> None:
        pass


def captions_stream(chunks: DataFrame, recognise: Recogniser, options: Options = Options(), late: str = "10 seconds") -> DataFrame:
    """Captions and accounts of a streaming DataFrame of chunks (session, at, pcm, ts, ended).

    A row with ended ends its session after the rows of its micro-batch; so does
    idle_ms of event time ts without any. A session that goes on after its end starts
    anew at position 0. Needs the RocksDB state store of gridloom.session.
    """
    rows = chunks.where(F.col("session").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=AudioProcessor(Captioner(recognise, options)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


#: The amplitude of code point 0, and the last code point that spoken() can say.
LOUD, LAST_POINT = 1_000, 31_767


def spoken(text: Column, window: int) -> Column:
    """Audio that says a text: each character is one window with its code point as amplitude above LOUD, blanks are silence."""
    units = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^\s?$"), F.lit("0000")).otherwise(F.lpad(F.hex(F.least(F.ascii(c), F.lit(LAST_POINT)) + LOUD), 4, "0")))
    little = F.transform(units, lambda u: F.repeat(F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)), window))
    return F.unhex(F.array_join(little, ""))


#: What spoken() takes for silence: the blanks and line ends of its pattern.
SILENT = np.array([9, 10, 11, 12, 13, 32, 0x85, 0x2028, 0x2029], np.uint32)
#: Bytes of audio in a batch that a task makes.
SPOKEN_BYTES = 1 << 24


def said(rows: DataFrame, text: str, window: int, pcm: str = "pcm", most: int = SPOKEN_BYTES) -> DataFrame:
    """rows with the column text replaced by its audio, the same as spoken() of it; made in numpy, in batches of `most` bytes or one text."""

    def speak(t: str) -> bytes:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") if t else SILENT[:1]
        units = np.where(np.isin(points, SILENT), 0, np.minimum(points, LAST_POINT) + LOUD)
        return np.repeat(units.astype("<i2"), window).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch: pa.RecordBatch, made: list[bytes | None], end: int) -> pa.RecordBatch:
            own = batch.slice(end - len(made), len(made))
            return pa.RecordBatch.from_arrays([own.column(c) for c in others] + [pa.array(made, pa.binary())], names=[*others, pcm])

        for batch in batches:
            made, size = [], 0
            for i, t in enumerate(batch.column(text)):
                own = None if not t.is_valid else speak(t.as_py())
                if made and size + len(own or b"") > most:
                    yield part(batch, made, i)
                    made, size = [], 0
                made.append(own)
                size += len(own or b"")
            if made:
                yield part(batch, made, batch.num_rows)

    others = [c for c in rows.columns if c != text]
    kinds = T.StructType([*(f for f in rows.schema if f.name != text), T.StructField(pcm, T.BinaryType())])
    return rows.mapInArrow(run, kinds)


def heard(window: int) -> Recogniser:
    """The recogniser of spoken(): the first sample of each window is a character, runs of silence are one blank."""

    def run(samples: np.ndarray) -> str:
        points = samples[: len(samples) // window * window : window].astype(np.int32)
        return " ".join(np.where(points > LOUD, points - LOUD, 32).astype("<u4").tobytes().decode("utf-32-le").split())

    return run
