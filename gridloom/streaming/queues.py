"""Bounded queues by arrival: one drops its oldest, or two isolated branches drop their newest; all is counted.

An event offers a frame or takes up to n. The same step works on a batch, folded over
sorted sessions, and on a stream, where a session's state is its waiting frames: at
most capacity of them for each branch.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.folds import folded

#: what is taken or dropped; waiting is the depth after the event.
OUTPUT = "session long, ord long, branch string, frame long, what string, waiting int"
OFFER, TAKE = "offer", "take"


@dataclass(frozen=True)
class Policy:
    """branches get every offered frame, each its own; oldest says which end goes from a full one."""

    capacity: int
    branches: tuple[str, ...] = ("",)
    oldest: bool = True


#: A second of 10 ms frames that may come late; and the two branches of 256 chunks behind a mixer.
JITTER = Policy(100)
FAN_OUT = Policy(256, ("captions", "recording"), oldest=False)


@dataclass
class Queues:
    waiting: dict[str, deque] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({k: list(v) for k, v in self.waiting.items()})

    @staticmethod
    def loads(text: str) -> Queues:
        return Queues({k: deque(v) for k, v in json.loads(text).items()})


def step(q: Queues, event: dict, policy: Policy) -> list[tuple]:
    """(ord, branch, frame, what, waiting) of one event (ord, kind, branch, frame, n); a branch that isn't one of the policy's has nothing."""
    out = []
    if event["kind"] == OFFER:
        for branch in policy.branches:
            own = q.waiting.setdefault(branch, deque())
            dropped = None
            if len(own) < policy.capacity:
                own.append(int(event["frame"]))
            elif policy.oldest and policy.capacity:
                dropped = own.popleft()
                own.append(int(event["frame"]))
            else:
                dropped = int(event["frame"])
            if dropped is not None:
                out.append((event["ord"], branch, dropped, "dropped", len(own)))
    elif event["kind"] == TAKE and event["branch"] in policy.branches:
        own = q.waiting.setdefault(event["branch"], deque())
        for _ in range(min(int(event["n"]), len(own))):
            out.append((event["ord"], event["branch"], own.popleft(), "taken", len(own)))
    return out


def _events(events: DataFrame) -> DataFrame:
    return events.select("session", "ord", "kind", F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce("frame", F.lit(0)).cast("long").alias("frame"), F.coalesce("n", F.lit(1)).cast("int").alias("n"))


def bounded_batch(events: DataFrame, policy: Policy) -> DataFrame:
    """OUTPUT rows over whole sessions of events (session, ord, kind, branch, frame, n), by ord. Null n takes one; null kinds do nothing."""
    return folded(_events(events), "ord", Queues, lambda q, e: (q, step(q, e, policy)), OUTPUT)


class QueueProcessor(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queues", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q = Queues.loads(self.state.get()[0]) if self.state.exists() else Queues()
        out = [(key[0], *x) for e in pd.concat(list(rows)).sort_values("ord", kind="stable").to_dict("records") for x in step(q, e, self.policy)]
        self.state.update((q.dumps(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def bounded_stream(events: DataFrame, policy: Policy) -> DataFrame:
    """The same over a stream; a micro-batch is taken by ord, and later ones as they arrive."""
    return _events(events).groupBy("session").transformWithStateInPandas(statefulProcessor=QueueProcessor(policy), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def depths(moves: DataFrame) -> DataFrame:
    """(session, branch, taken, dropped, deepest) over OUTPUT rows."""
    count = lambda what: F.count_if(F.col("what") == what)
    return moves.groupBy("session", "branch").agg(count("taken").alias("taken"), count("dropped").alias("dropped"), F.max("waiting").alias("deepest"))
