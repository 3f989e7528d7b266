"""Wording rules over documents that each say one statement more: what the rules find beside a document's own text.

Statements are dealt by document, and the SQL lists what each of them means, so the two sides share no rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import dates, experience, flags, languages, rules, work_modes
from loomfield.functions import eligibility as el
from loomfield.registry import Tables, query

_EU = "AT,BE,BG,CY,CZ,DE,DK,EE,ES,FI,FR,GR,HR,HU,IE,IT,LT,LU,LV,MT,NL,PL,PT,RO,SE,SI,SK"
#: Statement, countries, scope.
ELIGIBILITY = (
    ("We are hiring worldwide.", "", "worldwide"), ("Work from anywhere in the world!", "", "worldwide"), ("We hire globally, except in India.", None, None), ("We are a global remote-first company.", None, None),
    ("Not open to candidates outside the United States.", "US", "countries"), ("This role is within the EU.", _EU, "countries"), ("Remote - Canada or Mexico", "CA,MX", "countries"), ("Remote - Atlantis", None, None),
    ("You must be based in Germany.", "DE", "countries"), ("Open to candidates in India and Nepal.", "IN,NP", "countries"), ("We have offices in Germany.", None, None), ("US citizens only.", "US", "countries"),
    ("Tell us what you did; only then apply.", None, None), ("Must be located in the UK.", "GB", "countries"), ("Candidates in EMEA only.", None, "regions"), ("Our EMEA team is large.", None, None), ("Nothing is said.", None, None),
)
#: Statement, labels.
PERMITS = (
    ("Must be authorized to work in the US.", "us_work_authorization"), ("US work authorization is not required.", ""), ("You need the right to work in the UK.", "uk_right_to_work"), ("An EU work permit is needed.", "eu_work_permit"),
    ("No security clearance required.", ""), ("Active security clearance.", "security_clearance"), ("US citizens only.", "citizenship,us_work_authorization"), ("Indian citizens only.", "india_work_permit"),
    ("Candidates who are not authorized to work in the US will not be considered.", "us_work_authorization"), ("Citizenship is required; TS/SCI too.", "citizenship,security_clearance"), ("Indian work permit, e-verify.", "india_work_permit,us_work_authorization"), ("Nothing is said.", ""),
)
#: Names of places, countries, scope; and what the places say of the way of work.
REQUIREMENTS = (
    (("India", "Bavaria", "india"), "IN", "countries", None), (("Worldwide",), None, "worldwide", None), (("EMEA", "anywhere"), None, "regions", None), (("Europe", "Germany"), "DE", "countries", None), (("Bavaria", " "), None, None, None),
    (("Hybrid", "hybrid "), None, None, "hybrid"), (("In  Office", "Hybrid"), None, None, None), (("On-site",), None, None, "onsite"), ((), None, None, None),
)
#: Statement, flags, labels.
FLAGS = (
    ("A registration fee applies.", "fee_requested", ""), ("There is no registration fee.", "", ""), ("You must pay a small fee before joining.", "fee_requested", ""), ("We build systems for processing fees.", "", ""), ("This is an unpaid role.", "unpaid", ""), ("We grant unpaid leave.", "", ""),
    ("The job is commission-only.", "commission_only", ""), ("A guaranteed placement!", "too_good", ""), ("We never promise a guaranteed placement.", "", ""), ("Submit your CV for future openings.", "not_a_job", ""), ("Send a message on WhatsApp.", "suspicious_contact", ""),
    ("It is a night shift.", "", "night_shift"), ("Freelancers may ask.", "", "freelance"), ("We have quarterly offsites.", "", "occasional_office"), ("The security deposit is waived; commission only.", "commission_only", ""), ("Nothing is said.", "", ""),
)
#: Statement, languages asked for, languages welcomed.
LANGUAGES = (
    ("Fluent in German.", "german", ""), ("Fluent French is a plus.", "", "french"), ("Korean is required.", "korean", ""), ("Italian (B2). Danish preferred.", "italian", "danish"), ("Italian (B2), Danish preferred.", "", "italian"), ("For Spanish-speaking markets.", "", ""), ("A Tamil interpreter.", "tamil", ""),
    ("Languages: English, Dutch.", "dutch", ""), ("Strong command of Thai; good Czech market sense.", "thai", ""), ("Native Polish.", "polish", ""), ("polish your skills.", "", ""), ("Nothing is said.", "", ""),
)
#: Statement, last second for applications from 2026-02-01.
DEADLINES = (
    ("Apply by 12 March 2026.", "2026-03-12"), ("Deadline: March 12, 2026", "2026-03-12"), ("Applications close in March 2026.", "2026-03-01"), ("Last date 2026/03/05", "2026-03-05"), ("Apply before 25/12/2026.", "2026-12-25"), ("Apply before 05/06/2026.", None),
    ("Closes in 10 days.", "2026-02-11"), ("Apply by 5 January.", "2027-01-05"), ("Founded on 12 March 2016.", None), ("Rolling basis.", None),
)
#: Statement, least and most years, level.
YEARS = (
    ("3-5 years of experience.", "3.0", "5.0", None), ("At least 4 years.", "4.0", None, None), ("Up to 3 years.", None, "3.0", None), ("6-12 months.", "0.5", "1.0", None), ("18 months of experience.", "1.5", None, None), ("Less than a year.", "0.0", "1.0", None),
    ("Operating for 25 years.", None, None, None), ("2+ years. Freshers welcome.", None, None, "entry"), ("0-1 years. Freshers welcome.", "0.0", "1.0", "entry"), ("Not an entry-level job.", None, None, None), ("Nothing is said.", None, None, None),
)


#: Statement, way of work.
MODES = (
    ("The position is remote.", "remote"), ("Painter (Remote)", "remote"), ("Work with remote teams.", None), ("Remote or hybrid.", None), ("3 days a week on site.", "hybrid"), ("A hybrid schedule.", "hybrid"), ("A hybrid of oil and water.", None), ("Painters are on-site.", "onsite"),
    ("Not remote, but on site.", "onsite"), ("Come for an in-person interview.", None), ("Remote.io makes brushes.", None), ("This is a remote job; our hybrid policy is on the next page.", "remote"), ("Location: remote. #LI-Hybrid", None), ("The option to work remotely.", None), ("Nothing is said.", None),
)
#: Statement, least, most, currency, period.
PAY = (
    ("Salary: ₹12-18 LPA.", "1200000", "1800000", "INR", "year"), ("The daily rate is £350.", "350", "350", "GBP", "day"), ("Your monthly wage: €2,800", "2800", "2800", "EUR", "month"), ("Between $90k and $110k.", "90000", "110000", "USD", "year"), ("We raised $25 million.", None, None, None, None),
    ("Reward $15,000. Your base pay is $95,000 to $105,000.", "95000", "105000", "USD", "year"), ("$9,500", None, None, None, None), ("Up to 8 lakhs per annum.", None, "800000", "INR", "year"), ("From £40,000 a year.", "40000", None, "GBP", "year"), ("Nothing is said.", None, None, None, None),
)


def _pick(values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def _said(values: tuple) -> Column:
    # The line between keeps a document's own words out of the 45 characters around the statement.
    return F.concat_ws("\n", "text", F.lit("-" * 60), _pick(tuple(v[0] for v in values)))


def _sql(values: tuple, columns: str) -> str:
    quote = lambda x: "cast(null as varchar)" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({n}, {', '.join(quote(x) for x in v[1:])})" for n, v in enumerate(values))
    return f"select doc_id, {columns} from documents join (values {rows}) as meant(n, {columns}) on doc_id % {len(values)} = n"


#: A document's own words may name a region close to a cue, which counts where the statement settles nothing; statement 2 does.
_OWN_REGION = rf"""
len(list_filter(regexp_extract_all(text, '(?i)[\s\S]{{0,40}}\b(?:{"|".join(el.REGION_WORDS)})\b[\s\S]{{0,38}}'), lambda x: regexp_matches(x, '{el.CUES}'))) > 0
"""


@query(f"select m.doc_id, countries, case when scope is null and m.doc_id % {len(ELIGIBILITY)} <> 2 and own then 'regions' else scope end as scope from ({_sql(ELIGIBILITY, 'countries, scope')}) m join (select doc_id, {_OWN_REGION} as own from documents) o using (doc_id)")
def stated_eligibility(t: Tables) -> DataFrame:
    """Countries and scope that each document's wording states."""
    found = t.spread("documents", "doc_id").select("doc_id", _said(ELIGIBILITY).alias("said")).select("doc_id", el.eligibility(F.col("said")).alias("e"))
    return found.select("doc_id", F.array_join("e.countries", ",").alias("countries"), "e.scope")


@query(_sql(PERMITS, "labels"))
def stated_permits(t: Tables) -> DataFrame:
    """Labels of the permits that each document's wording asks for."""
    return t.spread("documents", "doc_id").select("doc_id", _said(PERMITS).alias("said")).select("doc_id", F.array_join(el.permits(F.col("said")), ",").alias("labels"))


@query("""
select p_partkey, case p_partkey % 5 when 0 then 'Remote - ' || p_type when 2 then p_type || ' remote' when 4 then p_type || ', remote|Remote' else '' end as segments from part
""")
def title_remote_segments(t: Tables) -> DataFrame:
    """Parts of titles that state a remote place: titles of parts' names, with their types in brackets or behind a dash."""
    k, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    title = (
        F.when(k == 0, F.concat(name, F.lit(" (Remote - "), kind, F.lit(")"))).when(k == 1, F.concat(name, F.lit(" ["), kind, F.lit("]"))).when(k == 2, F.concat(name, F.lit(" - "), kind, F.lit(" remote")))
        .when(k == 3, F.concat(F.lit("Remote "), name)).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(", remote) | Remote")))
    )
    return t.part.select("p_partkey", F.array_join(el.title_segments(title), "|").alias("segments"))


@query(_sql(REQUIREMENTS, "countries, scope, mode"))
def applicant_places(t: Tables) -> DataFrame:
    """Requirements of structured postings on where applicants are, and places that only name a way of work."""
    names = _pick(tuple(x[0] for x in REQUIREMENTS))
    rows = t.documents.select("doc_id", el.applicant_requirements(names).alias("r"), el.mode_of_places(names).alias("mode"))
    return rows.select("doc_id", F.array_join("r.countries", ",").alias("countries"), "r.scope", "mode")


@query(_sql(FLAGS, "flags, labels"))
def stated_flags(t: Tables) -> DataFrame:
    """Flags and labels that each document's wording raises."""
    rows = t.spread("documents", "doc_id").select("doc_id", _said(FLAGS).alias("said"))
    hard, soft = flags.hard_flags(F.lit(""), F.col("said")), flags.soft_labels(F.lit(""), F.col("said"))
    return rows.select("doc_id", F.array_join(F.transform(hard, lambda x: x["flag"]), ",").alias("flags"), F.array_join(soft, ",").alias("labels"))


@query(_sql(MODES, "mode"))
def stated_modes(t: Tables) -> DataFrame:
    """The way of work that each document's wording states."""
    rows = t.spread("documents", "doc_id").select("doc_id", _said(MODES).alias("said"))
    return rows.select("doc_id", work_modes.work_mode(F.col("said")).alias("mode"))


@query(rf"""
select m.doc_id, cast(low as double) as low, cast(high as double) as high, currency, period from ({_sql(PAY, 'low, high, currency, period')}) m
""")
def stated_pay(t: Tables) -> DataFrame:
    """Pay that a statement in each document's words discloses: the document's digits are taken out first, so that just the
    statement's figures are there."""
    said = F.concat_ws("\n", F.regexp_replace("text", "[0-9]", ""), F.lit("-" * 60), _pick(tuple(v[0] for v in PAY)))
    rows = t.spread("documents", "doc_id").select("doc_id", said.alias("said"))
    return rows.select("doc_id", rules.pay(F.col("said")).alias("p")).select("doc_id", "p.low", "p.high", "p.currency", "p.period")


@query(_sql(LANGUAGES, "required, nice"))
def stated_languages(t: Tables) -> DataFrame:
    """Languages that each document's wording asks for and welcomes."""
    rows = t.spread("documents", "doc_id").select("doc_id", languages.languages(_said(LANGUAGES)).alias("l"))
    return rows.select("doc_id", F.array_join("l.required", ",").alias("required"), F.array_join("l.nice", ",").alias("nice"))


@query(_sql(DEADLINES, "deadline"))
def stated_deadlines(t: Tables) -> DataFrame:
    """Days by which each document's wording wants applications."""
    at = dates.deadline(_said(DEADLINES), F.expr("timestamp'2026-02-01 10:00:00'"))
    return t.spread("documents", "doc_id").select("doc_id", F.date_format(at, "yyyy-MM-dd").alias("deadline"))


@query(f"select doc_id, cast(least as double) as least, cast(most as double) as most, level from ({_sql(YEARS, 'least, most, level')})")
def stated_years(t: Tables) -> DataFrame:
    """Years of experience and levels that each document's wording asks for."""
    rows = t.spread("documents", "doc_id").select("doc_id", _said(YEARS).alias("said"))
    return rows.select("doc_id", experience.experience(F.col("said")).alias("y"), experience.level(F.lit(""), F.col("said")).alias("level")).select("doc_id", "y.least", "y.most", "level")
