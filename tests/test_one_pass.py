"""What larger tables brought up: rules that went over a text once for each part of a match, and once more for each use of a value."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomfield.functions import flags, languages, matches
from loomfield.functions import flags, languages, matches
from loomfield.plans import texts, wording  # noqa: F401
from loomfield.registry import QUERIES


def test_days_are_counted_between_dates_and_hundredths_as_doubles(spark, tmp_path):
    rows = [(2, 20480550.0, datetime.datetime(2001, 7, 25, 10, 30)), (3, 1.0, datetime.datetime(2001, 8, 1, 23, 59))]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = QUERIES["format_postings"](spark, f"file://{tmp_path}").collect()
    assert sorted(r.posted for r in got) == ["1d ago", "8d ago"]
    assert [r.pay for r in got if r.o_orderkey == 2] == ["₹2048.05–2457.67 LPA"]


@pytest.mark.parametrize(("name", "passes"), [
    ("stated_pay", 1), ("stated_languages", 9), ("stated_years", 3), ("stated_deadlines", 1), ("stated_flags", 6), ("stated_eligibility", 3), ("stated_permits", 6), ("stated_modes", 1),
])
def test_a_pattern_runs_over_a_text_once(spark, tmp_path, name, passes):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\ufffe$1\uffff$2") == passes


def test_texts_that_hold_the_marks_of_matches(spark):
    said = "a￾b x1￿c x2"
    found = spark.createDataFrame([(said,), (said.replace("￾", "!").replace("￿", "?"),)], "t string").select(matches.around(F.col("t"), "x([0-9])", 3, 2, 1, "x[0-9]").alias("y")).collect()
    assert [[tuple(m) for m in r.y] for r in found] == [[("￾b ", "x1", "1", "￿c"), ("￿c ", "x2", "2", "")], [("!b ", "x1", "1", "?c"), ("?c ", "x2", "2", "")]]


def test_words_inside_of_words_are_passed_over(spark):
    rows = [("Is asp.net", "software-engineering"), ("A dotnet", "other"), ("Über-qa, testing prep", "qa-testing"), (None, "other")]
    from loomfield.functions import decisions

    got = spark.createDataFrame(rows, "t string, want string").select("want", decisions.role_family(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    said = spark.createDataFrame([("infusional fees; training fees apply. Éfluent german",)], "t string")
    row = said.select(flags.hard_flags(F.lit(""), F.col("t")).alias("f"), languages.languages(F.col("t")).alias("l")).first()
    assert [x.flag for x in row.f] == ["fee_requested"] and row.l.required == []
