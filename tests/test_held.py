"""The words that a text holds, found once in front of all rules: no rule may find less behind them than without them."""

from pyspark.sql import functions as F

from loomfield.functions import held, rules
from loomfield.plans import texts  # noqa: F401
from loomfield.registry import QUERIES

#: Wording that is glued, cut by signs, or spelt with letters that Unicode's cases take for others.
SAID = (
    "Rs.5,00,000 per year", "US$90k-US$120k a year", "salary:₹12LPA", "CTC 12 lakhs", "5+yrs", "under a year", "entrylevel role", "2024 passouts", "join immediately", "Notice period: 30 days",
    "3 daysonsite", "remotefirst", "#li-remote", "inoffice", "2 days a weekonsite", "a nonremote - Canada or Mexico", "Remote - IN, US", "enclosing within 5 days", "residue 5 mayor 2026, submitted",
    "We do not sponsorize visas. visa sponsorship", "Sponsors visas", "german(C1)", "Polish required", "fluent in GERMAN_", "uniform fees", "100%commission", "no pay", "unpaid leave, no stipend", "100%guarantee", "whats app: send cv",
    "only students can apply", "remote roleworldwide", "Globally", "not open to candidates outside India", "must be within the EU", "must be based in İtaly, germany", "only turKey", "only ıtaly in remote", "only candidates in Aſia-pacific, emea",
    "uscitizens only", "E-Verify", "top secret", "TS/SCI", "Right to work in the UK", "Join us only", "UK only", "Kgerman fluent german", "nothing", "", None,
)


def test_texts_are_taken_apart_once_for_all_rules(spark, tmp_path):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plan = QUERIES["rule_fields"](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(held._TOKEN) == 1


def test_held_words(spark):
    rows = spark.createDataFrame([("Paid 5 lakhs, unpaidly; SPONSORED Kİ", "a " * held.MOST_BYTES), (None, None)], "said string, long string")
    (one, none) = rows.select(held.held(F.col("said")).alias("some"), F.size(held.held(F.col("long"))).alias("n")).collect()
    assert (set(one.some), one.n, none.some, none.n) == ({"5", "lakhs", "paid", "sponsor", *held.ODD[1:]}, len(held._known), [], 0)


def test_rules_find_the_same_behind_held_words(spark):
    every = F.array(*[F.lit(w) for w in sorted(held._known)])
    rows = spark.createDataFrame([(t,) for said in SAID for t in ((said, said.upper(), f"x {said}, and so on", f"We are remote in Germany.\n{said}") if said else (said,))], "said string").repartition(4)
    some, whole = (rules.parts_of(F.lit(""), F.col("said"), words=w) for w in (held.held(F.col("said")), every))
    got = rows.select("said", *[F.struct(some[k].alias("some"), whole[k].alias("whole")).alias(k) for k in some]).collect()
    assert [(r.said, k, r[k]) for r in got for k in some if r[k].some != r[k].whole] == []
    assert {k for k in some if not any(r[k].some for r in got)} <= {"deadline"}
