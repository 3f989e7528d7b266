"""Streaming forms of the stateful operators: event dedupe, state folds, liveness over polls, keyed upserts per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomfield.operators import state as ops


def dedupe(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each event once: copies within the watermark are dropped, so state stays bounded by it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, late: str, width: str, kind: str) -> DataFrame:
    """Events by kind and time window; a window is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))


def liveness(polls: DataFrame) -> DataFrame:
    """``polls``: (board, at, items array) with one complete list per row. Per poll and item that was ever listed: misses in
    a row, and whether the second one closes it. State is kept by board; a board's batch is taken in the order of its polls."""
    schema = "board long, at timestamp, item string, missing_polls long, status string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses = dict(zip(*state.get)) if state.exists else {}
        out = []
        for poll in pd.concat(list(batches)).sort_values("at").itertuples():
            listed = set(poll.items if poll.items is not None else ())
            is_open = [i for i, m in misses.items() if m < ops.CLOSE_AFTER]
            found = sum(i in listed for i in is_open)
            if len(is_open) >= ops.GUARD_MIN_OPEN and found < len(is_open) * ops.GUARD_MIN_SHARE:
                continue
            misses = {i: 0 if i in listed else min(misses.get(i, 0) + 1, ops.CLOSE_AFTER) for i in {*misses, *listed}}
            out += [(key[0], poll.at, i, m, "closed" if m >= ops.CLOSE_AFTER else "open") for i, m in sorted(misses.items())]
        state.update((list(misses), list(misses.values())))
        yield pd.DataFrame(out, columns=["board", "at", "item", "missing_polls", "status"])

    kept = "items array<string>, misses array<long>"
    own = polls.select("board", "at", F.col("items"))
    return own.groupBy("board").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a stored table; a batch that is replayed changes nothing."""

    def run(batch: DataFrame, _: int) -> None:
        write(ops.merge(read(), batch, keys, version))

    return run
