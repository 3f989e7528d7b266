"""Flags, labels and languages of postings, with the wording that takes them back."""

import pytest
from pyspark.sql import functions as F

from loomfield.functions import flags, languages, matches


def hard(spark, title, said, source=None):
    rows = spark.createDataFrame([(title, said, source)], "t string, d string, s string")
    return {x.flag: x.evidence for x in rows.select(flags.hard_flags(F.col("t"), F.col("d"), F.col("s")).alias("y")).first().y}


def soft(spark, title, said, kind=None, source=None, remote=None):
    rows = spark.createDataFrame([(title, said, kind, source, remote)], "t string, d string, k string, s string, r string")
    return rows.select(flags.soft_labels(*[F.col(c) for c in "tdksr"]).alias("y")).first().y


def asked(spark, said):
    got = spark.createDataFrame([(said,)], "x string").select(languages.languages(F.col("x")).alias("y")).first().y
    return got.required, got.nice


@pytest.mark.parametrize(("title", "said", "want"), [
    ("Clerk", "A registration fee of Rs 500 applies.", {"fee_requested": "registration fee"}), ("Clerk", "There is no registration fee.", {}), ("Clerk", "The security deposit is waived.", {}), ("Clerk", "We cover the training charges.", {}),
    ("Clerk", "You will handle processing fees.", {}), ("Clerk", "You must pay a processing fee before joining.", {"fee_requested": "processing fee"}), ("Clerk", "No registration fee, says the site. A kit\n deposit is due.", {"fee_requested": "kit deposit"}),
    ("Clerk", "This is unpaid work.", {"unpaid": "unpaid"}), ("Clerk", "unpaid leave after a year, no salary history asked", {}), ("Clerk", "Paid in exposure.", {"unpaid": "Paid in exposure"}),
    ("Clerk", "commission only", {"commission_only": "commission only"}), ("Clerk", "This is not commission-only.", {}), ("Clerk", "Guaranteed job, earn 5,000 a day", {"too_good": "Guaranteed job"}), ("Clerk", "we never promise a guaranteed placement", {}),
    ("Talent Pool", "x", {"not_a_job": "Talent Pool"}), ("RVCE - EBA (January, 2027)", "x", {"not_a_job": "RVCE - EBA (January, 2027)"}), ("rvce - eba (January, 2027)", "x", {}), ("Clerk", "There are no open positions", {"not_a_job": "no open positions"}),
    (None, None, {}), ("", "", {}),
])
def test_hard_flags(spark, title, said, want):
    assert hard(spark, title, said) == want


def test_a_weak_fee_counts_only_where_the_candidate_pays(spark):
    far = "A processing fee is usual. " + "x " * 100 + "pay us"
    assert hard(spark, "", far) == {} and set(hard(spark, "", "A processing fee, payable upon arrival")) == {"fee_requested"}


def test_chat_contacts_count_unless_the_board_is_known(spark):
    said = "Send your CV by WhatsApp to this number"
    assert set(hard(spark, "", said)) == set(hard(spark, "", said, "himalayas")) == {"suspicious_contact"}
    assert hard(spark, "", said, "lever") == {} and hard(spark, "", "We build bots for Telegram") == {}


def test_flags_read_whole_texts(spark):
    assert set(hard(spark, "", "word " * 30_000 + "A registration fee applies.")) == {"fee_requested"}


def test_soft_labels(spark):
    assert soft(spark, "Agent", "Night shift. Visit the office once a month. Freelancers welcome") == ["night_shift", "freelance", "occasional_office"]
    assert soft(spark, "Agent", "x", "Contractor") == ["freelance"] and soft(spark, "Agent", "x", None, "himalayas", "remote") == ["remote_unverified"]
    assert soft(spark, "Agent", "work from home", None, "himalayas", "remote") == [] and soft(spark, None, None) == []


@pytest.mark.parametrize(("said", "required", "nice"), [
    ("Fluent in German. Native Hindi speaker. Fluent French is a plus", ["german", "hindi"], ["french"]), ("Korean is required", ["korean"], []), ("Italian (B2)", ["italian"], []), ("French speaking customer support agent", ["french"], []), ("Spanish-speaking markets", [], []),
    ("Punjabi Language Interpreter", ["punjabi"], []), ("Languages: English, Spanish", ["spanish"], []), ("Strong command of Dutch", ["dutch"], []), ("Good French GAAP knowledge", [], []), ("Czech preferred", [], ["czech"]),
    ("Native Polish", ["polish"], []), ("polish your skills, fluent polish", [], []), ("Fluent Thai. Thai is a plus", ["thai"], []), ("Nice to have: fluent Danish", [], ["danish"]), ("", [], []), (None, [], []),
])
def test_languages(spark, said, required, nice):
    assert asked(spark, said) == (required, nice)


def test_windows_reach_over_earlier_matches(spark):
    rows = spark.createDataFrame([("ab x cd x ef",), ("none",), (None,), ("x",)], "t string")
    got = [[tuple(m) for m in r.y] for r in rows.select(matches.around(F.col("t"), "x", 4, 3).alias("y")).collect()]
    assert got == [[("ab ", "x", " cd"), ("cd ".rjust(4), "x", " ef")], [], [], [("", "x", "")]]


def test_long_runs_of_blanks_cost_no_more_than_others(spark):
    gap = " " * 200_000
    said = f"earn{gap}x. fluent in{gap}x. languages:{gap}x. pay a{gap}x"
    assert hard(spark, "", said) == {} and asked(spark, said + " german") == ([], [])
