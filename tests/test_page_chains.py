"""Pages of one poll as intervals and as numbered lists, and the shapes of responses."""

import json

import pytest

from loomfield.sources import boards


@pytest.mark.parametrize(("pages", "want"), [
    ([(0, 100, 250, 200), (100, 100, None, 200), (200, 50, None, 200)], ("ok", 250, 250, 0, 0)), ([(0, 100, 250, 200), (200, 50, None, 200)], ("degraded", 150, 250, 1, 0)),
    ([(0, 100, 150, 200), (50, 100, None, 200)], ("ok", 150, 150, 0, 1)), ([(0, 100, 250, 200), (100, 100, None, 200)], ("degraded", 200, 250, 0, 0)), ([(0, 100, None, 200)], ("degraded", 100, None, 0, 0)), ([(0, 40, None, 200)], ("ok", 40, None, 0, 0)),
    ([(0, 0, 0, 200)], ("empty", 0, 0, 0, 0)), ([(0, 0, None, 404)], ("dead", 0, None, 0, 0)), ([(0, 0, None, 403)], ("blocked", 0, None, 0, 0)), ([(0, 100, 200, 200), (100, 100, None, 429)], ("degraded", 100, 200, 0, 0)),
    ([(100 * i, 100, 1600, 200) for i in range(16)], ("degraded", 1600, 1600, 0, 0)), ([(0, 100, 90, 200)], ("ok", 100, 90, 0, 0)),
])
def test_offsets(spark, pages, want):
    df = spark.createDataFrame([(7, *p) for p in pages], "board long, start long, size long, total long, http_status int").repartition(3)
    assert [tuple(r)[1:] for r in boards.offset_chains(df, "board").collect()] == [want]
    assert boards.offset_chains(df.limit(0), "board").collect() == []


@pytest.mark.parametrize(("pages", "want"), [
    ([(1, 200, 4, ["a", "b"]), (2, 200, 9, ["b", None]), (3, 200, None, [])], ("ok", 4, 4, 2)), ([(1, 200, 10, ["a"] * 8), (2, 200, None, [])], ("ok", 8, 10, 1)), ([(1, 200, 10, ["a"] * 7), (2, 200, None, [])], ("degraded", 7, 10, 1)),
    ([(1, 200, 2, ["a", "b"])], ("degraded", 2, 2, 2)), ([(1, 200, 2, ["a"]), (3, 200, None, [])], ("degraded", 1, 2, 1)), ([(1, 200, 2, ["a", "b"]), (2, 200, None, []), (3, 500, None, None)], ("ok", 2, 2, 2)),
    ([(1, 429, None, None)], ("blocked", 0, None, 0)), ([(1, 404, None, None)], ("dead", 0, None, 0)), ([(1, 200, None, None), (2, 200, None, [])], ("degraded", 0, None, 0)), ([(i, 200, None, ["a"]) for i in range(1, 61)] + [(61, 200, None, [])], ("degraded", 60, None, 1)),
])
def test_numbers(spark, pages, want):
    df = spark.createDataFrame([(7, *p) for p in pages], "board long, page int, http_status int, total long, ids array<string>").repartition(3)
    assert [tuple(r)[1:] for r in boards.numbered_chains(df, "board", "ids").collect()] == [want]


def test_shapes(spark):
    say = json.dumps
    cases = [
        (say({"jobs": [{"id": 1}, {"id": ""}]}), 200, None, ("ok", 1, 1)), (say({"jobs": []}), 200, None, ("empty", 0, 0)), (say({"jobs": {}}), 200, None, ("degraded", 0, 0)), (say({"jobs": [{"id": 1}, 5]}), 200, None, ("degraded", 0, 0)), (say([{"id": 1}]), 200, None, ("degraded", 0, 0)),
        (say({"jobs": [{"title": "x"}]}), 200, None, ("degraded", 0, 0)), ("<html>", 200, None, ("degraded", 0, 0)), (say({"jobs": [{"id": 1}]}), 200, "text/html", ("degraded", 0, 0)), ("{cut", 200, None, ("degraded", 0, 0)), (None, 200, None, ("degraded", 0, 0)),
        ("", 404, None, ("dead", 0, 0)), ("", 429, None, ("blocked", 0, 0)), ("", 500, None, ("degraded", 0, 0)), ("", None, None, ("degraded", 0, 0)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, body string, http_status int, kind string")
    got = {r.i: (r.status, r.postings, r.skipped) for r in boards.read_polls(df, "greenhouse", content_type="kind").collect()}
    assert {i: (cases[i][0], got[i]) for i in got if got[i] != cases[i][3]} == {}
    ashby = spark.createDataFrame([(say({"jobs": [{"id": 1, "isListed": False}]}), 200)], "body string, http_status int")
    assert boards.read_polls(ashby, "ashby").first().status == "empty"
