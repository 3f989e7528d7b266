"""Checks of a model's answers: what is not quoted from the text, or disagrees with its own quote, is dropped. The model
itself is a function that the caller gives to ``ask``; there is none by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a quote must have for its answer to stand.
REMOTE_WORDS = {
    "remote": ("remote", "work from home", "work from anywhere", "distributed", "anywhere", "wfh"),
    "hybrid": ("hybrid", "days a week", "days per week", "days in the office", "days in office", "in-office", "in office"),
    "onsite": ("on-site", "onsite", "on site", "in-office", "in office", "office-based", "in person", "in-person", "relocat", "located in"),
}
REGION_WORDS = ("emea", "apac", "latam", "europe", "european", "eu ", "asia", "north america", "americas", "amer", "africa", "middle east", "oceania")
WHO_MAY_APPLY = (
    r"(?:must|need to|have to|required to|should)\s+(?:be|reside|live|work|have)|only|open to|eligible|eligibility|residents?|citizens?|authori[sz]ed|work authori[sz]ation|located in|located within"
    r"|based (?:\w+ )?(?:in|within)\b|hiring in|candidates in|applicants in|reside|right to work|work (?:from|in|within)"
)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def quoted(quote: Column, text: Column) -> Column:
    """The quote, of four characters or more, stands in the text, whatever the case and white space."""
    q = squeezed(F.coalesce(quote, F.lit("")))
    return (F.length(q) >= 4) & F.contains(squeezed(F.coalesce(text, F.lit(""))), q)


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def checked(a: Column, text: Column) -> Column:
    """struct of the answers in ``a`` that stand: remote_type, eligibility_scope, visa_sponsorship, experience_min_years,
    experience_max_years. Worldwide is never taken from a model."""
    q = lambda name: squeezed(F.coalesce(a[f"{name}_quote"], F.lit("")))
    ok = lambda name: quoted(a[f"{name}_quote"], text)
    remote = F.lit(False)
    for mode, words in REMOTE_WORDS.items():
        remote = remote | ((a["remote_type"] == mode) & _any(q("remote_type"), words))
    numbers = F.transform(F.regexp_extract_all(q("experience"), F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
    low, high = a["experience_min_years"], a["experience_max_years"]
    stated = lambda n: n.isNull() | F.array_contains(numbers, n)
    years = ok("experience") & q("experience").rlike("year|yrs|experience") & stated(low) & stated(high) & F.coalesce(low <= high, F.lit(True))
    scope = ok("eligibility") & q("eligibility").rlike(WHO_MAY_APPLY)
    codes = F.coalesce(a["eligible_countries"], F.expr("cast(array() as array<string>)"))
    named = (F.size(codes) > 0) & F.forall(codes, lambda c: F.rlike(q("eligibility"), F.concat(F.lit(r"\b"), F.lower(c), F.lit(r"\b"))))
    return F.struct(
        F.when(ok("remote_type") & remote, a["remote_type"]).alias("remote_type"),
        F.when(scope & (((a["eligibility_scope"] == "countries") & named) | ((a["eligibility_scope"] == "regions") & _any(q("eligibility"), REGION_WORDS))), a["eligibility_scope"]).alias("eligibility_scope"),
        F.when(ok("visa") & q("visa").rlike("sponsor|visa") & (a["visa_sponsorship"] != "unknown"), a["visa_sponsorship"]).alias("visa_sponsorship"),
        F.when(years, low).alias("experience_min_years"), F.when(years, high).alias("experience_max_years"),
    )


def json_object(reply: Column, schema: str) -> Column:
    """The first reading of a reply that is a JSON object: as it is, without its fence, the fenced body, without reasoning, from
    the first to the last brace. Only the schema's keys stay."""
    text = F.trim(reply)
    unfenced = F.trim(F.regexp_replace(text, r"(?m)^```\w*\s*|```\s*$", ""))
    body = F.trim(F.regexp_extract(text, r"(?s)```\w*\s*(.*?)```", 1))
    calm = F.trim(F.regexp_replace(text, r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    braces = lambda c: F.regexp_extract(c, r"(?s)\{.*\}", 0)
    tries = [text, unfenced, body, calm, braces(unfenced), braces(calm), braces(body)]
    good = lambda c: F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(*[good(c) for c in tries])


def in_text(value: Column, text: Column) -> Column:
    """The value stands in the text as a whole word or phrase."""
    v = squeezed(value)
    safe = F.regexp_replace(v, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return (v != "") & F.rlike(squeezed(text), F.concat(F.lit(r"(^|[^\p{L}\p{N}])"), safe, F.lit(r"($|[^\p{L}\p{N}])")))


def cache_key(purpose: Column, prompt: Column, schema: Column, key: Column) -> Column:
    """Digest under which an answer is kept: what was asked, by which prompt and schema, about what."""
    return F.sha2(F.to_json(F.struct(key.alias("key"), prompt.alias("prompt"), purpose.alias("purpose"), schema.alias("schema"))), 256)


def ask(rows: DataFrame, complete: Callable[[str], str] | None, text: str = "text", reply: str = "reply") -> DataFrame:
    """``rows`` with the reply to each text; without a function all replies are null and no task runs Python."""
    if complete is None:
        return rows.withColumn(reply, F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{reply: [complete(t) if t else None for t in b[text]]})

    return rows.mapInPandas(run, rows.withColumn(reply, F.lit(None).cast("string")).schema)
