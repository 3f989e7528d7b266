"""The application log as keyed state: commands in, events out, follow-ups by timers.

A key is one application of a user. Commands are ``save``, ``move`` (to a state), ``apply``, ``next_action`` (with a time, or none) and
``notes``; each that changes something gives one event, which is written before the state follows. Saving twice, moving to the
state one is in, unknown states, and commands but save and apply to what was never saved, change nothing and give nothing.
To apply saves first, moves on only from ``saved``, and sets the follow-up ``FOLLOW_UP_DAYS`` ahead unless one is set.

Streamed, a next action sets an event-time timer: once the watermark passes it, a ``follow_up_due`` event comes out, unless the
action has moved or the application is closed by then. A key's state is one row, whatever its history.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The states of an application, those that end it, and when to ask for news.
STATES = ("saved", "applied", "assessment", "interview", "offer", "rejected", "withdrawn", "ghosted")
CLOSED = ("rejected", "withdrawn", "ghosted")
FOLLOW_UP_DAYS = 7
MOST_NOTE = 5000

KEPT = "state string, since timestamp, next_action timestamp, notes string"
OUT = "user_id long, posting_id long, at timestamp, event string, from_state string, to_state string, due timestamp, note_length int"


class Application:
    """One application: its state, since when, its next action and its notes; ``events`` collects what happens."""

    def __init__(self, state: str | None = None, since: datetime | None = None, next_action: datetime | None = None, notes: str | None = None):
        self.state, self.since, self.next_action, self.notes = state, since, next_action, notes
        self.events: list[tuple] = []

    def _event(self, at: datetime, name: str, to: str | None = None, due: datetime | None = None, length: int | None = None) -> None:
        self.events.append((at, name, self.state if name == "state_changed" else None, to, due, length))

    def take(self, at: datetime, command: str, to: str | None = None, due: datetime | None = None, text: str | None = None) -> None:
        if command in ("save", "apply") and self.state is None:
            self._event(at, "saved")
            self.state, self.since = "saved", at
        if self.state is None:
            return
        if command == "move":
            self._move(at, to)
        elif command == "apply" and self.state == "saved":
            self._move(at, "applied")
            if self.next_action is None:
                self._plan(at, at + timedelta(days=FOLLOW_UP_DAYS))
        elif command == "next_action":
            self._plan(at, due)
        elif command == "notes":
            self.notes = (text or "").replace("\0", "")[:MOST_NOTE]
            self._event(at, "notes_edited", length=len(self.notes))

    def _move(self, at: datetime, to: str | None) -> None:
        if to in STATES and to != self.state:
            self._event(at, "state_changed", to)
            self.state, self.since = to, at

    def _plan(self, at: datetime, due: datetime | None) -> None:
        self.next_action = due
        self._event(at, "next_action_set", due=due)


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x


class LogProcessor(StatefulProcessor):
    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("application", KEPT)

    def _load(self) -> Application:
        return Application(*map(_plain, self.kept.get())) if self.kept.exists() else Application()

    def _frame(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *e) for e in events], columns=[c.split(" ")[0] for c in OUT.split(", ")])
        return out.astype({"at": "datetime64[ns]", "due": "datetime64[ns]", "note_length": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        app = self._load()
        planned = app.next_action
        for r in pd.concat(list(rows)).sort_values(["at", "command_id"], kind="stable").itertuples():
            app.take(*map(_plain, (r.at, r.command, r.to_state, r.due, r.text)))
        if app.state is not None:
            self.kept.update((app.state, app.since, app.next_action, app.notes))
        if self.timers and app.next_action is not None and app.next_action != planned:
            self.handle.registerTimer(_millis(app.next_action))
        yield self._frame(key, app.events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        app, fired = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        due = app.next_action is not None and _millis(app.next_action) == fired and app.state not in CLOSED
        yield self._frame(key, [(app.next_action, "follow_up_due", None, app.state, app.next_action, None)] if due else [])

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1)).total_seconds() * 1000)


def log(commands: DataFrame, timers: str = "none") -> DataFrame:
    """Events of ``commands`` (user_id, posting_id, command_id, at, command, to_state, due, text), streamed or not. ``timers``:
    "eventtime" for follow-ups, which needs a watermark on ``at``. Streams need the RocksDB state store."""
    commands.sparkSession.streams  # noqa: B018  starts the coordinator of state stores, which a batch needs too
    own = commands.select("user_id", "posting_id", "command_id", "at", "command", "to_state", F.col("due").cast("timestamp").alias("due"), "text")
    return own.groupBy("user_id", "posting_id").transformWithStateInPandas(LogProcessor(timers != "none"), OUT, "append", timers)


def current(events: DataFrame) -> DataFrame:
    """(user_id, posting_id, state, since) that an event log leaves: the last move, else saved."""
    moved = events.where(F.col("event").isin("saved", "state_changed")).withColumn("state", F.coalesce("to_state", F.lit("saved")))
    return moved.groupBy("user_id", "posting_id").agg(F.max_by("state", F.struct("at", F.col("event") == "state_changed")).alias("state"), F.max("at").alias("since"))
