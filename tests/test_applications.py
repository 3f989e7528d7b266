"""The application log: commands to events, batch and streamed, and follow-ups by timers."""

import random
from datetime import datetime, timedelta

import pytest

from loomfield.streaming import applications as ap

T0 = datetime(2026, 3, 1, 9)
SCHEMA = "user_id long, posting_id long, command_id long, at timestamp, command string, to_state string, due timestamp, text string"


def row(n, user, posting, days, command, to=None, due=None, text=None):
    return (user, posting, n, T0 + timedelta(days=days), command, to, None if due is None else T0 + timedelta(days=due), text)


def test_commands_that_change_nothing_give_no_event(spark):
    rows = [
        row(1, 1, 1, 0, "move", "applied"), row(2, 1, 1, 1, "save"), row(3, 1, 1, 2, "save"), row(4, 1, 1, 3, "move", "saved"), row(5, 1, 1, 4, "move", "nowhere"), row(6, 1, 1, 5, "apply"), row(7, 1, 1, 6, "apply"),
        row(8, 1, 1, 7, "move", "interview"), row(9, 1, 1, 8, "next_action", due=30), row(10, 1, 1, 9, "notes", text="a\0b"), row(11, 1, 2, 0, "notes", text="lost"), row(12, 2, 1, 0, "apply"), row(13, 2, 1, 0, "next_action"),
    ]
    events = ap.log(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(map(str, ((r.user_id, r.posting_id, (r.at - T0).days, r.event, r.from_state, r.to_state, None if r.due is None else (r.due - T0).days, r.note_length) for r in events.collect())))
    assert got == sorted(map(str, [
        (1, 1, 1, "saved", None, None, None, None), (1, 1, 5, "state_changed", "saved", "applied", None, None), (1, 1, 5, "next_action_set", None, None, 12, None), (1, 1, 7, "state_changed", "applied", "interview", None, None),
        (1, 1, 8, "next_action_set", None, None, 30, None), (1, 1, 9, "notes_edited", None, None, None, 2),
        (2, 1, 0, "saved", None, None, None, None), (2, 1, 0, "state_changed", "saved", "applied", None, None), (2, 1, 0, "next_action_set", None, None, 7, None), (2, 1, 0, "next_action_set", None, None, None, None),
    ]))
    assert {(r.user_id, r.posting_id): r.state for r in ap.current(events).collect()} == {(1, 1): "interview", (2, 1): "applied"}
    assert ap.log(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streamed_log_equals_the_batch_and_timers_fire_once(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = [row(n, rng.randrange(3), rng.randrange(2), n / 4, rng.choice(["save", "apply", "move", "move", "next_action"]), rng.choice(ap.STATES), n / 4 + rng.randrange(1, 9)) for n in range(80)]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source).withWatermark("at", "0 seconds")
        ap.log(stream, "eventtime").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    for a in range(0, 80, 20):
        run(rows[a : a + 20])
    run([row(99, 99, 99, 60, "save")])
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    batch = [tuple(r) for r in ap.log(spark.createDataFrame([*rows, row(99, 99, 99, 60, "save")], SCHEMA)).collect()]
    fired = [r for r in got if r[3] == "follow_up_due"]
    assert sorted((r for r in got if r[3] != "follow_up_due"), key=key) == sorted(batch, key=key)
    # A follow-up is due where its action still stood, and the application was open, when the watermark passed it.
    assert fired and len(set(fired)) == len(fired) and all(r[5] not in ap.CLOSED and r[2] == r[6] for r in fired)
    assert {(r[0], r[1], r[6]) for r in fired} <= {(r[0], r[1], r[6]) for r in got if r[3] == "next_action_set"}
