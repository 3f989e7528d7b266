"""Ways of work that texts state, and mentions that say nothing of the job."""

import pytest
from pyspark.sql import functions as F

from loomfield.functions import work_modes

STATED = [
    ("We are remote-first.", "remote"), ("You can work from anywhere", "remote"), ("WFH until spring", "remote"), ("The position is remote", "remote"), ("Painter (Remote)", "remote"), ("Remote | Painter", "remote"), ("Remote - Kenya", "remote"),
    ("We hire remote painters", "remote"), ("Painting may be done remotely.", "remote"), ("An all-remote studio", "remote"), ("Paint remotely from Peru", "remote"), ("#LI-Remote", "remote"), ("remote-friendly", "remote"),
    ("Painter, Hybrid", "hybrid"), ("Hybrid (Lima)", "hybrid"), ("4 days in office", "hybrid"), ("3 days a week on site", "hybrid"), ("A hybrid schedule", "hybrid"), ("some office time", "hybrid"), ("hybrid/remote", "hybrid"), ("office 2 days", "hybrid"),
    ("This is a hybrid role with two days in the studio.", "hybrid"), ("Painters are on-site.", "onsite"), ("in-office", "onsite"), ("You work from office", "onsite"), ("in-person work", "onsite"), ("Onsite in Lima", "onsite"),
    ("not remote, but on site", "onsite"), ("There is no remote work here; painters are in office.", "onsite"), ("Come for an in-person interview. The role is remote.", "remote"),
    ("This is a remote job. Our hybrid policy is on the next page.", "remote"), ("This is a hybrid role based in Lima. Some teams are remote-first.", "hybrid"), ("The role is on-site. Other roles: Remote.", "onsite"),
]
UNSAID = [
    "remote or hybrid", "Painting remotely or on-site", "fully remote or hybrid", "not remote", "a non-remote job", "remote work is not for us",
    "Remote.io makes brushes", "RemoteOK", "Paint with remote teams", "local and remote painters", "remote desktops", "Remote positions are listed below", "Remote, Oregon", "a remote, quiet valley", "the option to work fully remote",
    "a hybrid of oil and water", "hybrid engines", "This is a hybrid role: half painter, half poet.", "WFH stipend", "an in-person interview", "not on-site", "not hybrid", "Location: remote. #LI-Hybrid", "", "  ", None, "nothing",
]


@pytest.fixture(scope="module")
def found(spark):
    cases = [*STATED, *((t, None) for t in UNSAID)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    return [(cases[r.i][0], r.m) for r in df.select("i", work_modes.work_mode(F.col("t")).alias("m")).orderBy("i").collect()]


def test_modes(found):
    assert found == [*STATED, *((t, None) for t in UNSAID)]


def test_statements_against_remote_work(spark):
    rows = [("This job isn't a fit for fully remote painters.", True, False), ("No remote option.", True, False), ("Remote control is not part of it.", False, False), ("The position is hybrid.", False, True), ("The role is based on-site.", False, True), ("The role is hybrid. 100% remote later.", False, False), (None, False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select("t", work_modes.refuses_remote(F.col("t")).alias("a"), work_modes.not_for_remote(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == rows


def test_mentions_behind_much_text(spark):
    text = "Words that say nothing. " * 5000 + "This position is remote."
    assert spark.createDataFrame([(text,)], "t string").select(work_modes.work_mode(F.col("t")).alias("m")).first().m == "remote"
