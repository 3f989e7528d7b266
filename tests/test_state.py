import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomfield.operators import scoring, state


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_is_idempotent_and_keeps_newer_rows(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (4, "n", None)], "k long, v string, raw long")
    delta = spark.createDataFrame([(1, "old", 4), (2, "new", 2), (2, "older", 1), (3, "add", 1), (4, "set", 1)], "k long, v string, raw long")
    once = state.merge(base, delta, ["k"], "raw")
    assert rows(once) == [(1, "a", 5), (2, "new", 2), (3, "add", 1), (4, "set", 1)]
    assert rows(state.merge(once, delta, ["k"], "raw")) == rows(once)
    assert rows(state.upsert_counts(base, delta, ["k"])) == [(1, 3)]


def test_liveness_guard_and_second_miss(spark):
    postings = [(1, f"p{i}", "open", i % 2) for i in range(6)] + [(2, "a", "open", 0), (2, "b", "closed", 2), (2, "c", "dead", 0), (3, "x", "open", 1)]
    df = spark.createDataFrame(postings, "board long, item string, status string, missing_polls int")
    listed = spark.createDataFrame([(1, "p0"), (2, "b"), (2, "c"), (2, "b")], "board long, item string")
    got = {(r.board, r.item): (r.status, r.missing_polls, r.suspect) for r in state.liveness(df, listed, "board", "item").collect()}
    assert got[(1, "p1")] == ("open", 1, True)  # one of six listed: the poll is not believed
    assert got[(2, "a")] == ("open", 1, False) and got[(2, "b")] == ("open", 0, False) and got[(2, "c")] == ("dead", 0, False)
    assert got[(3, "x")] == ("open", 1, False)  # not polled
    more = spark.createDataFrame([(2, "b")], "board long, item string")
    twice = state.liveness(spark.createDataFrame([(2, "a", "open", 1), (2, "b", "open", 1)], "board long, item string, status string, missing_polls int"), more, "board", "item")
    assert rows(twice.select("item", "status", "missing_polls")) == [("a", "closed", 2), ("b", "open", 0)]


def test_newest_copy_forms_agree(spark):
    data = [(1, 7, None, True, True), (2, 7, None, True, True), (3, 7, "x", True, True), (4, 7, "x", False, True), (5, 7, "x", True, False), (6, 8, None, True, True)]
    df = spark.createDataFrame(data, "id long, c long, p string, decided boolean, ok boolean")
    args = (["c", "p"], "id", F.col("decided") & F.col("ok"), ~F.col("decided"))
    assert rows(state.newest_copy(df, *args)) == rows(state.newest_copy_by_join(df, *args)) == [r for r in data if r[0] != 1]


def test_folds_and_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None)], "u long, t long, s string")
    assert sorted((r.u, r.state, r.transitions) for r in state.current_state(df, "u", "s", ["t"]).collect()) == [(1, "b", 2), (2, None, 0)]
    assert rows(state.pending(df, "s", F.lit("a")).select("u", "t")) == [(1, 3), (2, 1)]
    h = df.groupBy("u").agg(state.ids_hash(F.col("t")).alias("h")).collect()
    assert len({r.h for r in h}) == 2


@pytest.mark.parametrize(("ok", "blocked", "dead", "failures", "want"), [(True, False, False, 9, "active"), (False, True, False, 0, "blocked"), (False, False, True, 1, "quiet"), (False, False, True, 2, "dead")])
def test_board_status(spark, ok, blocked, dead, failures, want):
    df = spark.createDataFrame([(ok, blocked, dead, failures, "quiet")], "o boolean, b boolean, d boolean, f int, s string")
    assert df.select(state.next_board_status(*[F.col(x) for x in "obdfs"])).first()[0] == want


def test_scores(spark):
    one = spark.range(1)
    parts = {"skills": F.lit(40.0), "role": F.lit(12.5), "level": F.lit(None).cast("double")}
    assert one.select(scoring.total(parts, F.lit(False))).first()[0] == 81
    assert one.select(scoring.total(parts, F.lit(True))).first()[0] == 25
    assert one.select(scoring.total({"skills": F.lit(None).cast("double")}, F.lit(False))).first()[0] == 0
    assert one.select(scoring.bucket(F.lit(70), F.lit(False), F.lit(True), F.lit(False))).first()[0] == "strong"
    assert one.select(scoring.role_points(F.lit("Senior Data Engineer"), ["data engineer"], F.lit("data"), ["data"])).first()[0] == 25.0
    assert one.select(scoring.role_points(F.lit("Analyst"), ["data engineer"], F.lit("data"), ["data"])).first()[0] == 20.0
    assert one.select(scoring.text_skill_points(F.lit("We use C++ and Go"), ["c++", "rust"])).first()[0] == 20.0
    assert one.select(scoring.freshness(F.lit(100))).first()[0] == 3.0


def test_accumulating_upsert(spark):
    a = spark.createDataFrame([("s", dt.date(2024, 1, 1), 3, 7)], "source string, date date, n long, p long")
    b = spark.createDataFrame([("s", dt.date(2024, 1, 1), 2, 9), ("t", dt.date(2024, 1, 1), 1, 1)], "source string, date date, n long, p long")
    assert [(r.source, r.n, r.p) for r in state.accumulate(a, b, ["source", "date"], ["n"], ["p"]).orderBy("source").collect()] == [("s", 5, 9), ("t", 1, 1)]
