"""Structured fields of a board's posting, as variant expressions per board. Every mapper gives the same columns, null where
the board says nothing; odd types and shapes are nulls, never errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import geo
from loomfield.functions.html import html_to_text

#: Employment words, work modes, pay periods and level labels of the boards.
EMPLOYMENT = {
    "full_time": "full_time", "fulltime": "full_time", "permanent": "full_time", "regular": "full_time", "part_time": "part_time", "parttime": "part_time", "contract": "contract", "contractor": "contract",
    "freelance": "contract", "temporary": "temporary", "temp": "temporary", "intern": "intern", "internship": "intern", "volunteer": "volunteer", "per_diem": "per_diem", "perdiem": "per_diem",
}
WORKPLACE = {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite", "on site": "onsite"}
PERIODS = {
    "per-year-salary": "year", "per-month-salary": "month", "per-hour-wage": "hour", "annual": "year", "yearly": "year", "year": "year", "1 year": "year", "monthly": "month", "month": "month", "1 month": "month",
    "hourly": "hour", "hour": "hour", "1 hour": "hour", "daily": "day", "day": "day",
}
LEVELS = {
    "internship": "intern", "intern": "intern", "trainee": "entry", "apprentice": "entry", "entry level": "entry", "entry": "entry", "junior": "entry", "graduate": "entry", "no experience": "entry", "mid level": "mid",
    "mid": "mid", "mid senior level": "mid", "intermediate": "mid", "middle": "mid", "senior": "senior", "lead": "lead", "manager": "lead", "director": "director", "executive": "director", "vp": "director",
}
ANY_TIMEZONE = 30


def _table(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def employment(c: Column) -> Column:
    """Codes of a stated type ("Full Time / Contract"), in order, distinct; words not known are other."""
    words = F.filter(F.transform(F.split(c, "[,/]"), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_")), lambda x: x != "")
    codes = F.array_distinct(F.transform(words, lambda w: F.coalesce(_table(EMPLOYMENT, w), F.lit("other"))))
    return F.when(F.size(codes) > 0, codes)


def level_label(c: Column) -> Column:
    return _table(LEVELS, F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")))


def himalayas_level(levels: Column) -> Column:
    """One level of a list: entry unless senior ones stand beside it; otherwise the only level they map to."""
    low = F.transform(levels, lambda x: F.lower(F.trim(x)))
    senior = F.arrays_overlap(low, F.array(*[F.lit(x) for x in ("senior", "manager", "director", "executive")]))
    known = {"mid-level": "mid", "senior": "senior", "manager": "lead", "director": "director", "executive": "director"}
    mapped = F.array_distinct(F.array_compact(F.transform(low, lambda x: _table(known, x))))
    return F.when(F.array_contains(low, "entry-level"), F.when(~senior, "entry")).when(F.size(mapped) == 1, F.get(mapped, 0))


def epoch(seconds: Column) -> Column:
    """Seconds since 1970 as a time, between 2000 and 2100."""
    return F.when(seconds.between(946684800, 4102444800), F.timestamp_seconds(seconds))


def _text(c: Column) -> Column:
    """Markup, plain or escaped once more, as text; blank is null."""
    plain = F.when(c.contains("<") | c.contains("&lt;"), html_to_text(F.when(c.contains("<"), c).otherwise(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))))).otherwise(F.trim(c))
    return F.nullif(plain, F.lit(""))


#: Where a board keeps a posting's title.
TITLES = {"greenhouse": ("title",), "lever": ("text",), "ashby": ("title",), "workable": ("title",), "recruitee": ("title", "translations.en.title"), "smartrecruiters": ("name",), "himalayas": ("title",)}
BOARDS = tuple(TITLES)
KINDS = {"places": "array<string>", "employment_type": "array<string>", "eligible_countries": "array<string>", "posted_at": "timestamp", "deadline_at": "timestamp", "pay": "struct<low:double,high:double,currency:string,period:string>"}
NAMES = ("places", "remote_type", "employment_type", "seniority", "apply_url", "posted_at", "deadline_at", "company_name", "eligible_countries", "pay", "description")


#: Stands in front of markup that is not text yet.
MARK = "\x01"


def marked(c: Column) -> Column:
    return F.concat(F.lit(MARK), c)


def unmarked(c: Column) -> Column:
    """Text of what ``columns`` gave with ``marked``: markup becomes text, all else stays."""
    return F.when(c.startswith(MARK), _text(F.replace(F.when(c.startswith(MARK), c), F.lit(MARK), F.lit("")))).otherwise(c)


def columns(ats: str, job: str = "job", text: Callable[[Column], Column] = _text) -> dict[str, Column]:
    """The fields that a board's postings state, from the variant ``job``. ``text`` makes text of markup."""
    get = lambda path, kind="string": F.try_variant_get(F.col(job), f"$.{path}", kind)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda *paths: F.coalesce(*[blank(get(p)) for p in paths])
    true = lambda path: F.coalesce(get(path, "boolean"), F.lit(False))
    place = lambda *paths: blank(F.array_join(F.array_compact(F.array(*[blank(get(p)) for p in paths])), ", "))
    many = lambda path, inner: F.transform(get(path, "array<variant>"), lambda v: F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{i}", "string")), F.lit("")) for i in inner])), ", "))
    places = lambda *lists: F.array_distinct(F.filter(F.flatten(F.array_compact(F.array(*lists))), lambda x: x != ""))
    one = lambda c: F.array_compact(F.array(c))
    when = lambda *paths: F.coalesce(*[get(p).try_cast("timestamp") for p in paths])

    def pay(low: str, high: str, currency: Column, period: Column) -> Column:
        a, b = (F.when(get(p, "double") > 0, get(p, "double")) for p in (low, high))
        return F.when((a.isNotNull() | b.isNotNull()) & period.isNotNull(), F.struct(a.alias("low"), b.alias("high"), F.upper(currency).alias("currency"), period.alias("period")))

    period = lambda path: _table(PERIODS, F.lower(F.trim(get(path))))
    own: dict[str, Column] = {}
    if ats == "greenhouse":
        own = {"places": places(one(first("location.name"))), "apply_url": first("absolute_url"), "posted_at": when("first_published"), "company_name": first("company_name"), "description": text(get("content"))}
    elif ats == "lever":
        created = get("createdAt", "double") / 1000
        lists = F.array_join(F.filter(F.transform(get("lists", "array<variant>"), lambda v: F.concat_ws("\n", F.try_variant_get(v, "$.text", "string"), F.regexp_replace(F.try_variant_get(v, "$.content", "string"), "<[^>]*>", " "))), lambda s: s != ""), "\n\n")
        own = {
            "places": places(one(first("categories.location"))), "employment_type": employment(get("categories.commitment")), "remote_type": _table(WORKPLACE, F.lower(F.trim(get("workplaceType")))), "apply_url": first("applyUrl", "hostedUrl"),
            "posted_at": F.when(created.between(631152000, 4133980799), F.timestamp_seconds(created)), "description": blank(F.concat_ws("\n\n", first("descriptionPlain", "description"), lists)),
            "pay": pay("salaryRange.min", "salaryRange.max", first("salaryRange.currency"), period("salaryRange.interval")),
        }
    elif ats == "ashby":
        mode, stated = _table(WORKPLACE, F.lower(F.trim(get("workplaceType")))), first("workplaceType")
        own = {
            "places": places(one(first("location")), many("secondaryLocations", ("location",)), one(place("address.postalAddress.addressLocality", "address.postalAddress.addressRegion", "address.postalAddress.addressCountry"))),
            "remote_type": F.coalesce(mode, F.when(stated.isNull() & true("isRemote"), "remote")), "employment_type": employment(get("employmentType")), "posted_at": when("publishedAt"), "apply_url": first("applyUrl", "jobUrl"),
            "description": F.coalesce(first("descriptionPlain"), text(get("descriptionHtml"))), "pay": pay("compensation.min", "compensation.max", first("compensation.currency", "compensation.currencyCode"), period("compensation.interval")),
        }
    elif ats == "workable":
        listed = many("locations", ("city", "region", "country"))
        own = {
            "places": F.when(F.size(places(listed)) > 0, places(listed)).otherwise(places(one(place("city", "state", "country")))), "remote_type": F.when(true("telecommuting"), "remote"), "employment_type": employment(get("employment_type")),
            "seniority": level_label(get("experience")), "apply_url": first("application_url", "url", "shortlink"), "posted_at": when("published_on", "created_at"), "description": text(get("description")),
        }
    elif ats == "recruitee":
        listed = many("locations", ("city", "state", "country"))
        modes = F.array_compact(F.array(*[F.when(true(k), F.lit(v)) for k, v in (("remote", "remote"), ("hybrid", "hybrid"), ("on_site", "onsite"))]))
        code = F.regexp_replace(F.get(F.split(F.lower(get("employment_type_code")), "_"), 0), "^(full|part)time$", "$1 time")
        own = {
            "places": F.when(F.size(places(listed)) > 0, places(listed)).otherwise(places(one(place("city", "state_name", "country")))), "remote_type": F.when(F.size(modes) == 1, F.get(modes, 0)), "employment_type": employment(code),
            "seniority": level_label(get("experience_code")), "apply_url": first("careers_apply_url", "careers_url"), "posted_at": when("published_at", "created_at"),
            "description": blank(F.concat_ws("\n\n", text(F.coalesce(get("description"), get("translations.en.description"))), text(F.coalesce(get("requirements"), get("translations.en.requirements"))))),
            "pay": pay("salary.min", "salary.max", first("salary.currency"), period("salary.period")),
        }
    elif ats == "smartrecruiters":
        url = F.concat(F.lit("https://jobs.smartrecruiters.com/"), first("company.identifier"), F.lit("/"), first("id"))
        own = {
            "places": places(one(place("location.city", "location.region", "location.country"))), "remote_type": F.when(true("location.remote"), "remote").when(true("location.hybrid"), "hybrid"), "employment_type": employment(get("typeOfEmployment.label")),
            "seniority": level_label(first("experienceLevel.label", "experienceLevel.name", "experienceLevel.id", "experienceLevel")), "apply_url": url, "posted_at": when("releasedDate"),
        }
    elif ats == "himalayas":
        named = F.filter(F.transform(get("locationRestrictions", "array<string>"), F.trim), lambda x: x != "")
        all_known = F.forall(named, lambda x: F.size(geo.expand_regions(F.array(x))) > 0)
        url = first("applicationLink", "guid")
        own = {
            "remote_type": F.lit("remote"), "eligible_countries": F.when((F.size(named) > 0) & all_known, F.array_sort(geo.expand_regions(named))), "employment_type": employment(get("employmentType")),
            "seniority": himalayas_level(get("seniority", "array<string>")), "company_name": first("companyName"), "posted_at": epoch(get("pubDate", "long")), "deadline_at": epoch(get("expiryDate", "long")),
            "apply_url": F.when(url.rlike("^https?://"), url), "description": text(get("description")), "pay": pay("minSalary", "maxSalary", first("currency"), period("salaryPeriod")),
        }
    else:
        raise ValueError(f"unknown board kind {ats}")
    own["title"] = first(*TITLES[ats])
    return own


def fields(rows: DataFrame, ats: str, job: str = "job") -> DataFrame:
    """``rows`` with the fields of the variant ``job``: places, remote_type, employment_type, seniority, apply_url,
    posted_at, deadline_at, company_name, eligible_countries, pay (low, high, currency, period), description."""
    own = columns(ats, job)
    return rows.select("*", *[(own[n] if n in own else F.lit(None)).cast(KINDS.get(n, "string")).alias(n) for n in NAMES])


def any_board(source: Column, job: str = "job") -> dict[str, Column]:
    """The fields and the title of a posting of whichever board ``source`` names, in one pass over mixed rows. The description is
    for ``unmarked``, so that one conversion serves all boards."""
    by = {ats: columns(ats, job, marked) for ats in BOARDS}
    pick = lambda n: F.coalesce(*[F.when(source == ats, own[n].cast(KINDS.get(n, "string"))) for ats, own in by.items() if n in own])
    return {n: pick(n) for n in (*NAMES, "title")}
