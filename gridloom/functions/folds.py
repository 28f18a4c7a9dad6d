"""Folds over the ordered rows of each session, with one state and one batch of rows in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, order: str, start: Callable, fold: Callable, schema: str, close: Callable | None = None) -> DataFrame:
    """A fold over each session of rows in order, over sorted partitions.

    fold(state, row) gives the next state and a list of output tuples; close(state)
    those of a session's end. schema's first column is the session.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                if not begun or row["session"] != session:
                    if begun and close:
                        out += [(session, *x) for x in close(state)]
                    session, state, begun = row["session"], start(), True
                state, made = fold(state, row)
                out += [(session, *x) for x in made]
            yield pd.DataFrame(out, columns=names)
        if begun and close:
            yield pd.DataFrame([(session, *x) for x in close(state)], columns=names)

    return rows.repartition("session").sortWithinPartitions("session", order).mapInPandas(run, schema)
