import pytest
from pyspark.sql import functions as F

from loomfield.functions import decisions, eligibility, geo, html, jsonld, rules, text


def ask(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("said", "want"), [
    ("Salary: ₹12-18 LPA", (1200000, 1800000, "INR", "year")), ("CTC up to 8 lakhs per annum", (None, 800000, "INR", "year")), ("$100-120k per year", (100000, 120000, "USD", "year")),
    ("pay $45 per hour", (45, 45, "USD", "hour")), ("from £40,000 a year", (40000, None, "GBP", "year")), ("We raised $25 million", None), ("team of 300 people since 2019", None), ("$9,500", None),
    ("$50,000 or $70,000", None), ("$50,000 or $70,000 per year", (70000, 70000, "USD", "year")), ("", None), (None, None),
    ("the daily rate is £350", (350, 350, "GBP", "day")), ("Yearly figures aside, your monthly wage: €2,800", (2800, 2800, "EUR", "month")), ("between $90k and $110k", (90000, 110000, "USD", "year")), ("$90k and $110k", (90000, 90000, "USD", "year")),
    ("Referral reward $15,000. Your base pay is $95,000 to $105,000.", (95000, 105000, "USD", "year")), ("Pay is $95,000; another pay band is $120,000", None), ("₹9 cr seed, funding of 2021", None), ("won $40 million", None),
    ("stipend of Rs. 12,000 per month", (12000, 12000, "INR", "month")), ("stipend Rs. 12,000 per month", (12000, 12000, "INR", "month")), ("EUR 45.000", None), ("CAD 80,000+", (80000, None, "CAD", "year")), ("80,000 AED", None), ("$700 annual", None),
])
def test_pay(spark, said, want):
    got = ask(spark, said, rules.pay)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("said", "want"), [
    ("3-5 years of experience", (3, 5)), ("2+ years of experience required", (2, None)), ("1 year of experience and 4 years of experience", None), ("Freshers welcome", (0, None)),
    ("45 years of experience", None), ("founded 10 years ago", None), (None, None),
])
def test_experience(spark, said, want):
    got = ask(spark, said, rules.experience)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("said", "want"), [("We are unable to offer visa sponsorship", "no"), ("Visa sponsorship available", "yes"), ("no sponsorship. We sponsor work visas", None), ("nothing", None)])
def test_visa(spark, said, want):
    assert ask(spark, said, rules.visa) == want


def test_languages_and_joining(spark):
    assert ask(spark, "Fluent in German. Native Hindi speaker. Fluent French is a plus", rules.languages) == ["german", "hindi"]
    assert tuple(ask(spark, "notice period of 2 weeks", rules.joining)) == ("notice_days", 14)
    assert tuple(ask(spark, "immediate joiners", rules.joining)) == ("immediate", 0)


def test_skills(spark):
    terms = spark.createDataFrame([("python", "python"), ("c++", "cpp"), ("machine learning", "ml"), ("go", "go")], "term string, skill string")
    docs = spark.createDataFrame([(1, "Requirements:\n- Python, C++\nNice to have:\n- machine learning and python"), (2, "google it\nGo is a plus"), (3, None)], "id long, text string")
    got = sorted(tuple(r) for r in rules.skills(docs, "id", "text", terms).collect())
    assert got == [(1, "cpp", "must"), (1, "ml", "nice"), (1, "python", "must"), (2, "go", "nice")]


@pytest.mark.parametrize(("title", "stated", "said", "want"), [
    ("Software Intern", None, "", "internship"), ("Early Stage Engineer", None, "", "unknown"), ("HR stage", None, "", "internship"), ("Graduate Trainee", None, "6 months training", "internship"),
    ("Trainee", None, "permanent job", "full_time"), ("Dev", "FULL_TIME,CONTRACTOR", "", "full_time"), ("Dev", "contract", "", "contract"), ("Dev", None, "This role is part-time", "part_time"),
    ("Dev", None, "unpaid leave after a year", "unknown"), ("Dev", None, "an unpaid role", "volunteer"), ("Dev", None, "maternity cover", "temporary"), ("Dev", None, "a stipend is paid", "internship"),
])
def test_employment_kind(spark, title, stated, said, want):
    df = spark.createDataFrame([(title, stated, said, None)], "t string, s string, d string, l string")
    assert df.select(decisions.employment_kind(F.col("t"), F.col("d"), F.col("s"), F.col("l")).alias("y")).first().y == want


@pytest.mark.parametrize(("title", "said", "countries", "scope", "auth", "remote", "located", "want"), [
    ("Dev", "We are not hiring in India", ["IN"], None, [], None, [], "no"), ("Dev - US only", "", [], None, [], None, [], "no"), ("Dev - US only", "", ["IN"], None, [], None, [], "unknown"),
    ("Dev", "", ["IN", "US"], "countries", [], None, [], "yes"), ("Dev", "", ["IN"], "countries", ["citizenship"], None, [], "unknown"), ("Dev", "", [], "worldwide", [], None, [], "yes"),
    ("Dev", "", [], "worldwide", ["us_work_authorization"], None, [], "no"), ("Dev", "", ["DE"], "countries", [], None, [], "no"), ("Dev", "", [], "regions", [], None, [], "unknown"),
    ("Dev", None, None, None, None, "remote", ["IN"], "yes"), (None, None, None, None, None, None, None, "unknown"),
])
def test_india_eligible(spark, title, said, countries, scope, auth, remote, located, want):
    schema = "t string, d string, c array<string>, s string, a array<string>, r string, l array<string>"
    df = spark.createDataFrame([(title, said, countries, scope, auth, remote, located)], schema)
    assert df.select(decisions.india_eligible(*[F.col(x) for x in "tdcsarl"]).alias("y")).first().y == want


def test_families(spark):
    assert [ask(spark, t, decisions.role_family) for t in ("Data Entry Clerk", "Data Engineer", "Test Prep Tutor", "Backend Developer", "Zookeeper")] == ["operations", "data", "other", "software-engineering", "other"]


@pytest.mark.parametrize(("title", "said", "want"), [
    ("Clerk", "We won't hire in India.", "no"), ("Clerk", "We never recruit people from India.", "no"), ("Clerk", "Not eligible for applicants in northern India", "no"), ("Clerk", "You must live outside India", "no"), ("Clerk", "Everywhere other than China and India", "no"),
    ("Clerk", "We are no longer accepting applications from India", "no"), ("Clerk", "We hire in Indiana, not in Ohio", "yes"), ("Clerk", "Our India team does not work late", "yes"), ("Clerk", "We hire in India. Not for people in Nepal", "yes"),
    ("Clerk - Germany-based", "", "no"), ("Clerk (Nordic residents)", "", "no"), ("Clerk (India only)", "", "yes"), ("Clerk, home-based", "", "yes"),
])
def test_refusals_of_india(spark, title, said, want):
    df = spark.createDataFrame([(title, said)], "t string, d string")
    none = F.lit(None).cast("array<string>")
    assert df.select(decisions.india_eligible(F.col("t"), F.col("d"), none, F.lit("worldwide"), none, F.lit("remote"), none).alias("y")).first().y == want


def test_countries(spark):
    assert [ask(spark, c, geo.country_code) for c in ("India", " UK ", "US", "in", "nowhere", None)] == ["IN", "GB", "US", None, None, None]
    df = spark.createDataFrame([(["North America", "india", "??"],)], "x array<string>")
    assert df.select(geo.expand_regions(F.col("x")).alias("y")).first().y == ["US", "CA", "IN"]


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a&amp;lt;b</p><script>x()</script><ul><li>one<li>two</ul>", "a<b\n\n- one\n- two"), ("<!-- x --><b>bold</b>\nline<br>next", "bold line\nnext"), (None, ""), ("plain", "plain"), ("a <unclosed", "a"), ("<style>p{", ""),
])
def test_html_to_text(spark, page, want):
    assert ask(spark, page, html.html_to_text).replace("\n\n", "\n") == want.replace("\n\n", "\n")


def test_long_pages_are_cut(spark):
    got = ask(spark, "<p>" + ("word " * 100 + "</p><p>") * 100, html.html_to_text)
    assert got.endswith("[truncated]") and len(got) < 20_020


def test_job_links(spark):
    page = '<a href="/jobs/1#x">a</a><a href="https://h.com/jobs/2">b</a><a class=q href=\'/jobs/1\'>again</a><a href="http://other.com/jobs/3">c</a><a href="/jobs">list</a><a href="/jobs/login/x">d</a><a href="/careers/x.pdf">e</a><a href="http://[bad/jobs/1">f</a>'
    df = spark.createDataFrame([("https://h.com/careers", page), (None, None)], "u string, h string")
    assert [r.y for r in df.select(html.job_links(F.col("u"), F.col("h")).alias("y")).collect()] == [["https://h.com/jobs/1", "https://h.com/jobs/2"], []]


def test_structured_postings(spark):
    page = """<script type="application/ld+json">/* c */ {"@graph":[{"@type":"Organization"},{"@type":"JobPosting","title":"Dev","validThrough":"2026-01-31","employmentType":["FULL_TIME","odd"],
      "jobLocationType":"TELECOMMUTE","jobLocation":{"address":{"addressCountry":"IN"}},"baseSalary":{"currency":"usd","value":{"minValue":100,"maxValue":200,"unitText":"WEEK"}},}]}</script><script type='application/ld+json'>{bad</script>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "id long, html string")
    rows = jsonld.postings(df, "id", "html").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.id, r.title, str(r.deadline_at), r.employment_type, r.remote_type, r.country, r.pay_currency, r.pay_period) == (1, "Dev", "2026-01-31 23:59:59", "FULL_TIME,OTHER", "remote", "IN", "USD", "month")
    assert round(r.pay_min) == 433 and round(r.pay_max) == 867


def test_text_columns(spark):
    assert ask(spark, "a@b.co token=abc http://x?key=1&y=2 Bearer abc.def", text.redact) == "[REDACTED] [REDACTED] http://x?key=[REDACTED]&y=2 Bearer [REDACTED]"
    assert ask(spark, "x/y/z", text.split_source_id) == "y/z" and ask(spark, "xyz", text.split_source_id) == "xyz" and ask(spark, "x/", text.split_source_id) == "x/"
    assert ask(spark, "Acme Labs Ltd", text.initials) == "AL" and ask(spark, "acme", text.initials) == "AC"
    assert ask(spark, " a\x00\n b ", lambda c: text.clean_note(c, 3)) == "a b"
    assert text.like_pattern("50%_\\") == "%50\\%\\_\\\\%"


def test_many_mentions_take_time_in_proportion(spark):
    df = spark.createDataFrame([("No security clearance is needed. India it is. " * 20_000 + "A security clearance is required for candidates in India.",)], "x string")
    got = df.select(eligibility.permits(F.col("x")).alias("p"), eligibility.eligibility(F.col("x")).alias("e")).first()
    assert got.p == ["security_clearance"] and got.e.countries == ["IN"]
