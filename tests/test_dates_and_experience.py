"""Deadlines and years of experience: every shape, and what makes it no statement."""

import pytest
from pyspark.sql import functions as F

from loomfield.functions import dates, experience


@pytest.mark.parametrize(("said", "country", "want"), [
    ("Apply by 12 March 2026.", None, "2026-03-12"), ("Deadline: March 12, 2026", None, "2026-03-12"), ("Applications close in March 2026", None, "2026-03-01"), ("Last date 2026/03/05", None, "2026-03-05"), ("apply before 25/12/2026", None, "2026-12-25"),
    ("apply before 05/06/2026", None, None), ("apply before 05/06/2026", "in", "2026-06-05"), ("apply before 05/06/2026", "US", "2026-05-06"), ("Closes in 10 days", None, "2026-02-11"), ("The deadline is within 2 weeks", None, "2026-02-15"),
    ("Apply by 5 March", None, "2026-03-05"), ("Apply by 5 January", None, "2027-01-05"), ("Founded 12 March 2016", None, None), ("Apply by 31 Feb 2026", None, "2026-02-01"), ("Apply by 45 March 2026", None, "2026-03-01"),
    ("Founded on 1 May 2015 in a small town of ours, we grow. Apply by 2 May 2026, or 3 May 2026", None, "2026-05-02"), ("12 Sept. 2026 is the cut-off", None, "2026-09-12"), ("rolling basis", None, None), ("", None, None), (None, None, None),
])
def test_deadlines(spark, said, country, want):
    rows = spark.createDataFrame([(said, country)], "x string, c string").withColumn("seen", F.expr("timestamp'2026-02-01 10:00:00'"))
    got = rows.select(dates.deadline(F.col("x"), F.col("seen"), F.col("c")).alias("y")).first().y
    assert (str(got) if got else None) == (f"{want} 23:59:59" if want else None)


def test_dates_that_need_the_time_of_the_posting_are_open_without_it(spark):
    rows = spark.createDataFrame([("Apply by 5 March",), ("Closes in 10 days",), ("Apply by 5 March 2026",)], "x string")
    assert [str(r.y)[:10] for r in rows.select(dates.deadline(F.col("x")).alias("y")).collect()] == ["None", "None", "2026-03-05"]
    assert [r.y for r in spark.createDataFrame([("open until filled",), ("x",), (None,)], "x string").select(dates.rolling(F.col("x")).alias("y")).collect()] == [True, False, False]


@pytest.mark.parametrize(("said", "title", "want"), [
    ("3-5 years of experience", None, (3, 5)), ("5 to 3 yrs", None, (3, 5)), ("2+ years", None, (2, None)), ("at least 4 years", None, (4, None)), ("up to 3 years", None, (None, 3)), ("1.5 years of experience", None, (1.5, None)),
    ("operating for 25 years", None, None), ("a child 5 years old, minimum", None, None), ("3 years in Python", None, (3, None)), ("45 years of experience", None, None), ("6-12 months", None, (0.5, 1)), ("0-6 months", None, (0, 0.5)),
    ("18 months of experience", None, (1.5, None)), ("18 months of fun", None, None), ("40-48 months of experience", None, None), ("less than a year", None, (0, 1)), ("under 1 year of experience", None, (1, None)), ("below 1 year", None, (0, 1)),
    ("2 years of experience. 4 years of experience", None, None), ("0-1 years. Freshers welcome", None, (0, 1)), ("Freshers welcome", None, (0, None)), ("2+ years. Freshers welcome", None, None), ("Freshers welcome", "Senior Engineer", None),
    ("This is not an entry-level job", None, None), ("from freshers to senior engineers", None, None), ("", "Graduate Engineer", (0, None)), ("", "Engineer", None), (None, None, None),
])
def test_experience(spark, said, title, want):
    rows = spark.createDataFrame([(said, title)], "x string, t string")
    got = rows.select(experience.experience(F.col("x"), F.col("t")).alias("y")).first().y
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("title", "said", "want"), [
    ("Software Intern", "", "intern"), ("SVP Sales", "", "director"), ("Head of Data", "", "director"), ("Senior Process Associate", "", None), ("Senior Engineer", "", "senior"), ("Engineering Manager", "", "lead"), ("SDE-3", "", "senior"),
    ("Software Engineer II", "", "mid"), ("Engineer I", "", "entry"), ("Trainee", "", "entry"), ("Engineer", "Freshers welcome", "entry"), ("Engineer", "", None), (None, None, None),
])
def test_levels(spark, title, said, want):
    rows = spark.createDataFrame([(title, said)], "t string, x string")
    assert rows.select(experience.level(F.col("t"), F.col("x")).alias("y")).first().y == want
