"""Registered queries read whole tables and whole texts. Their expected rows are written here, apart from the queries' SQL."""

import hashlib

from pyspark.sql import functions as F

from loomfield.functions import decisions, rules, text
from loomfield.plans import texts  # noqa: F401
from loomfield.registry import QUERIES


def ask(spark, folder, name, table, rows, schema):
    """Rows of a registered query over one small table."""
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{table}.parquet")
    return QUERIES[name](spark, f"file://{folder}").collect()


def test_description_blocks_reads_every_document(spark, tmp_path):
    rows = [(i, "Duties\n\n- one thing.\n• more.\n\nA sentence.") for i in (0, 3, 6)] + [(9, " \n "), (1, "Duties\nA sentence."), (2, "a\nb")]
    got = ask(spark, tmp_path, "description_blocks", "documents", rows, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in got) == [(0, 3, 1, 1, 1), (1, 2, 1, 0, 1), (2, 1, 0, 1, 0), (3, 3, 1, 1, 1), (6, 3, 1, 1, 1)]


def test_blocks(spark):
    said = "Role:\r\n\r\nFirst line\n second line  \n\n\n* a\n  - b \n· c\n\n- d\nnot in a list\n\nEnds here.\n\n" + "h" * 71 + "\n\n- alone"
    got = spark.createDataFrame([(said,), (None,), (" \n\n ",), ("x\n\n" * 500,)], "x string").select(text.blocks(F.col("x")).alias("b")).collect()
    assert [(b.kind, b.lines) for b in got[0].b] == [
        ("heading", ["Role"]), ("paragraph", ["First line", "second line"]), ("list", ["a", "b", "c"]), ("paragraph", ["- d", "not in a list"]), ("paragraph", ["Ends here."]), ("paragraph", ["h" * 71]), ("list", ["alone"]),
    ]
    assert (got[1].b, got[2].b, len(got[3].b)) == ([], [], 400)


FILLER = "Some words that say nothing of note.\n" * 1000  # 37 000 characters


def test_rules_read_behind_the_first_characters(spark, tmp_path):
    said = (
        FILLER + "Salary: ₹12-18 LPA. 3-5 years of experience. This is a remote role. Apply by 2026-03-05. Visa sponsorship available. "
        "Fluent in German. Notice period of 2 weeks. Commission only."
    )
    (row,) = ask(spark, tmp_path, "rule_fields", "documents", [(1, said)], "doc_id long, text string")
    assert (row.pay_low, row.pay_high, row.pay_currency, row.pay_period) == (1200000, 1800000, "INR", "year")
    assert (row.years_least, row.years_most, row.work_mode, str(row.deadline), row.visa) == (3, 5, "remote", "2026-03-05 23:59:59", "yes")
    assert (row.joining, row.joining_days, row.languages, row.flags) == ("notice_days", 14, "german", "commission_only")


def test_decisions_read_behind_the_first_characters(spark, tmp_path):
    rows = [(1, FILLER + "This role is part-time. We are unable to consider candidates in India."), (2, FILLER + "nothing")]
    got = ask(spark, tmp_path, "decided_documents", "documents", rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.employment_kind, r.india_eligible) for r in got) == [(1, "part_time", "no"), (2, "unknown", "unknown")]


def test_language_is_judged_on_the_whole_text(spark, tmp_path):
    english, german = "the team is here for you and we are with you ", "der Hund und die Katze sind nicht mit dem Mann für das Haus "
    rows = [(1, "en", english * 40 + german * 400), (2, "en", english * 400)]
    got = ask(spark, tmp_path, "non_english", "documents", rows, "doc_id long, lang string, text string")
    assert sorted((r.foreign_text, r.n) for r in got) == [(False, 1), (True, 1)]


def test_long_runs_of_blanks_cost_no_more_than_others(spark):
    df = spark.createDataFrame([("Trainee", "5" + " " * 200_000 + "x, and 6 months training")], "title string, said string")
    none = F.lit(None).cast("string")
    got = df.select(rules.experience(F.col("said")).alias("e"), decisions.employment_kind(F.col("title"), F.col("said"), none, none).alias("k")).first()
    assert (got.e, got.k) == (None, "internship")


def test_exact_duplicates_are_equal_to_their_ends(spark, tmp_path):
    same = "shared opening " * 500
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a"), (4, "short"), (5, "short"), (6, "other")]
    got = ask(spark, tmp_path, "exact_dup_docs", "documents", rows, "doc_id long, text string")
    assert sorted((r.n, r.first_id, r.newest_id) for r in got) == [(2, 1, 3), (2, 4, 5)]


def test_page_text_is_whole(spark, tmp_path):
    rows = [(i, "<p>" + "word " * 8000 + f"</p><p>end {i}</p>") for i in range(2)]
    got = ask(spark, tmp_path, "page_text", "pages", rows, "page_id long, html string")
    want = ["word " * 7999 + f"word\nend {i}" for i in range(2)]
    assert sorted((r.page_id, r.chars, r.digest) for r in got) == [(i, len(w), hashlib.md5(w.encode()).hexdigest()) for i, w in enumerate(want)]


def test_page_links_are_all_given(spark, tmp_path):
    html = "".join(f'<a href="/{i}">x</a>' for i in [*range(100), 5])
    got = ask(spark, tmp_path, "page_links", "pages", [(1, "https://h.com/jobs", html)], "page_id long, url string, html string")
    assert [r.link for r in got] == [f"https://h.com/jobs/{i}" for i in range(100)]
