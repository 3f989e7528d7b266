"""Dates by which a posting wants applications. The first date that stands near a word for a deadline counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.held import DIGITS, has, within
from loomfield.functions.matches import around, ungrouped
from loomfield.functions.text import says

#: Month names, shapes of dates, words for deadlines, and places that write the day or the month first.
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
DAY_MONTH = rf"(?i:(?<![0-9])([0-9]{{1,2}})(?![0-9])[\s\-/.,]+({MONTH})[\s,.\-/]*([0-9]{{4}})?)"
MONTH_DAY = rf"(?i:({MONTH})[\s.\-/]+([0-9]{{1,2}})(?![0-9])(?:[\s,.\-/]+([0-9]{{4}}))?)"
MONTH_YEAR = rf"(?i:({MONTH})[\s.,]+([0-9]{{4}})(?![0-9]))"
NUMERIC = r"(?<![0-9])([0-9]{1,2})[\s/\-.]+([0-9]{1,2})[\s/\-.]+([0-9]{4})(?![0-9])"
ISO = r"(?<![0-9])([0-9]{4})[\s/\-.]+([0-9]{1,2})[\s/\-.]+([0-9]{1,2})(?![0-9])"
RELATIVE = r"(?i:(?:clos(?:e|es|ing)?|deadline)\b[^\n]{0,24}?\b(?:in|within)\s+([0-9]{1,3})\s+(minute|hour|day|week|month)s?\b)"
DEADLINE_WORDS = r"(?i)\b(?:apply|applications?|closing|\bclos(?:e|es|ing)\b|deadline|last\s+date|due|submit|cut[\s-]*off|before)\b"
ROLLING = r"(?i)\brolling(?:\s+basis)?\b|\bopen\s+until\s+filled\b|\buntil\s+filled\b"
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
DAY_FIRST, MONTH_FIRST = ("IN", "GB", "UK", "AU", "AE"), ("US",)

#: Where any shape can begin: a cheap test in front of them.
_NAMED = r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[A-Za-z]{0,6}[\s.,/-]+[0-9]"
START = rf"(?=[0-9]|(?i:clos|deadline)|{_NAMED})"
#: Where one place of a text fits several shapes, the first of them is read.
SHAPES = {"relative": RELATIVE, "day_month": DAY_MONTH, "month_day": MONTH_DAY, "month_year": MONTH_YEAR, "iso": ISO, "numeric": NUMERIC}


def _day(year: Column, month: Column, day: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", F.nullif(year.cast("string"), F.lit("")), pad(month), pad(day)).try_cast("date")


def _month(name: Column) -> Column:
    """Number of a month by the first letters of its name."""
    return F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.left(F.lower(name), F.lit(3))) + 2) / 3).cast("int")


def _end(day: Column) -> Column:
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + 86399)


def deadline(text: Column, seen: Column | None = None, country: Column | None = None, words: Column | None = None) -> Column:
    """End of the day (UTC) of the deadline. ``seen``, the time of the posting, settles relative dates and those without a year
    (the next such day); ``country`` settles which of day and month goes first. What stays open is no date.
    ``words``: what the text holds, if that is known (``held``)."""
    seen = F.lit(None).cast("timestamp") if seen is None else seen
    country = F.upper(F.trim(F.lit(None).cast("string") if country is None else country))
    today = F.date_from_unix_date(F.floor(F.unix_seconds(seen) / 86400).cast("int"))

    def read(m: Column) -> Column:
        part = lambda shape, i: F.regexp_extract(m["said"], f"^{SHAPES[shape]}$", i)
        number = lambda shape, i: part(shape, i).try_cast("int")
        is_a = lambda shape: m["said"].rlike(f"^{ungrouped(SHAPES[shape])}$")
        near = F.right(m["before"], F.lit(30)).rlike(DEADLINE_WORDS) | F.left(m["after"], F.lit(15)).rlike(DEADLINE_WORDS)

        def named(shape: str, month: int, day: int) -> Column:
            mon, d, year = _month(part(shape, month)), number(shape, day), part(shape, 3)
            this = _day(F.lpad(F.year(today).cast("string"), 4, "0"), mon, d)
            coming = F.when(this >= today, this).when(this < today, _day(F.lpad((F.year(today) + 1).cast("string"), 4, "0"), mon, d))
            # A day that the month does not have leaves the month.
            return F.when(year != "", F.coalesce(_day(year, mon, d), _day(year, mon, F.lit(1)) if shape == "day_month" else F.lit(None).cast("date"))).otherwise(coming)

        a, b, y = number("numeric", 1), number("numeric", 2), part("numeric", 3)
        day_first, month_first = _day(y, b, a), _day(y, a, b)
        plain = (
            F.when(month_first.isNull(), day_first).when(day_first.isNull(), month_first).when(country.isin(*DAY_FIRST), day_first).when(country.isin(*MONTH_FIRST), month_first)
        )
        unit = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
        after = F.unix_seconds(seen) + number("relative", 1).cast("long") * F.try_element_at(unit, F.lower(part("relative", 2)))
        date = (
            F.when(is_a("day_month"), named("day_month", 2, 1)).when(is_a("month_day"), named("month_day", 1, 2)).when(is_a("month_year"), _day(part("month_year", 2), _month(part("month_year", 1)), F.lit(1)))
            .when(is_a("iso"), _day(part("iso", 1), number("iso", 2), number("iso", 3))).when(is_a("numeric"), plain)
        )
        return F.when(is_a("relative"), F.date_from_unix_date(F.floor(after / 86400).cast("int"))).when(near, date)

    every = ungrouped("|".join(SHAPES.values()))
    marked = lambda w: has(w, DIGITS) & says(text, "appl", "clos", "deadline", "last", "due", "submit", "cut", "before")
    first = lambda w: F.get(F.array_compact(F.transform(F.when(marked(w), around(text, f"(?:{every})", 30, 15, start=START)), read)), F.lit(0))
    return _end(within(words, text, first))


def rolling(text: Column) -> Column:
    """Applications are taken until the place is filled."""
    return F.coalesce(says(text, "rolling", "filled") & text.rlike(ROLLING), F.lit(False))
