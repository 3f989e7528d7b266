"""Sequences of polls: the fold against one poll after the other, and against the streamed form's rule."""

import random

from loomfield.operators import state


def one_by_one(polls, stored):
    """Plain: each poll looks at every item."""
    items, seen, closed, suspects = {i: [s, m] for i, s, m in stored}, {}, {}, 0
    for at, listed in polls:
        is_open = [i for i, (s, _) in items.items() if s == "open"]
        if len(is_open) >= 5 and sum(i in listed for i in is_open) < 0.2 * len(is_open):
            suspects += 1
            continue
        for i in listed:
            if items.get(i, ["open"])[0] in ("open", "closed"):
                items[i], seen[i] = ["open", 0], at
                closed.pop(i, None)
        for i, x in items.items():
            if i not in listed and x[0] == "open":
                x[1] += 1
                if x[1] >= 2:
                    x[0], closed[i] = "closed", at
    return {i: (s, m, seen.get(i), closed.get(i), suspects) for i, (s, m) in items.items()}


def test_fold_equals_one_poll_after_the_other(spark):
    rng = random.Random(3)
    rows, stored, want = [], [], {}
    for board in range(60):
        own = [(f"i{i}", rng.choice(["open", "closed", "dead"]), rng.randrange(2)) for i in range(rng.randrange(8))]
        stored += [(board, i, s, m) for i, s, m in own]
        polls = []
        for at in range(rng.randrange(12)):
            listed = {f"i{i}" for i in range(rng.choice([6, 12, 30])) if rng.random() < rng.choice([0.05, 0.3, 0.8])}
            polls.append((at, listed))
            rows += [(board, at, i) for i in listed] * rng.choice([1, 2]) + ([(board, at, None)] if not listed else [])
        want |= {(board, i): v for i, v in one_by_one(polls, own).items()}
    rows += [(None, 1, "x"), (7, None, "x")]
    polls = spark.createDataFrame(rows, "board long, at long, item string").repartition(5)
    before = spark.createDataFrame(stored, "board long, item string, status string, missing_polls long")
    got = {(r.board, r.item): (r.status, r.missing_polls, r.seen_at, r.closed_at, r.suspects) for r in state.fold_polls(polls, "board", "item", "at", before).collect()}
    assert got.keys() == want.keys() and {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert any(v[4] for v in want.values()) and state.fold_polls(polls.limit(0), "board", "item", "at").collect() == []


def test_a_long_sequence_takes_time_by_what_it_lists(spark):
    fold = state.PollFold()
    for at in range(30_000):
        fold.take(at, {at, at + 1, 30_001 + at % 7})
    rows = fold.rows()
    assert len(rows) == 30_008 and sum(r[1] == "open" for r in rows) < 20
