"""Structured job postings (JSON-LD) in pages, mapped to fields with variant expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""

#: Pay units, and how many make a month where there is no period of that name.
UNITS = {"HOUR": "hour", "DAY": "day", "WEEK": "month", "MONTH": "month", "YEAR": "year"}
EMPLOYMENT = ("FULL_TIME", "PART_TIME", "CONTRACTOR", "TEMPORARY", "INTERN", "VOLUNTEER", "PER_DIEM", "OTHER")


def tidy(c: Column) -> Column:
    """A script body without what pages put around JSON: CDATA, comments, trailing commas, a byte-order mark."""
    for pattern, instead in ((r"^\x{FEFF}", ""), (r"(?s)<!\[CDATA\[|\]\]>|<!--|-->", ""), (r"(?s)/\*.*?\*/", ""), (r"(?m)^\s*//.*$", ""), (r",(\s*[}\]])", "$1")):
        c = F.regexp_replace(c, pattern, instead)
    return F.trim(c)


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, node): every JobPosting in a page's blocks, whether alone, in a list or in a graph."""
    blocks = pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BLOCK), F.lit(1))).alias("block"))
    data = blocks.select(key, F.try_parse_json(tidy(F.col("block"))).alias("v")).where("v is not null")
    many = lambda path: F.try_variant_get("v", path, "array<variant>")
    listed = data.select(key, F.explode(F.coalesce(many("$"), many("$['@graph']"), F.array("v"))).alias("node"))
    return listed.where(_is_posting(F.col("node")))


def _is_posting(node: Column) -> Column:
    kind = F.coalesce(F.try_variant_get(node, "$['@type']", "string"), F.array_join(F.try_variant_get(node, "$['@type']", "array<string>"), ","))
    return F.coalesce(kind.rlike("(^|,|\")JobPosting($|,|\")"), F.lit(False))


def first_posting(html: Column) -> Column:
    """The first JobPosting node of a page, or null; no row is exploded for it."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BLOCK), F.lit(1))
    data = F.array_compact(F.transform(blocks, lambda b: F.try_parse_json(tidy(b))))
    many = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    listed = F.flatten(F.transform(data, lambda v: F.coalesce(many(v, "$"), many(v, "$['@graph']"), F.array(v))))
    return F.when(F.coalesce(html, F.lit("")).contains("ld+json"), F.get(F.filter(listed, _is_posting), 0))


def columns(node: str) -> dict[str, Column]:
    """The fields of a structured posting. Weekly pay becomes monthly; a bare date is valid to the end of its day."""
    get = lambda path, kind="string": F.try_variant_get(node, path, kind)
    unit = F.upper(F.coalesce(get("$.baseSalary.value.unitText"), get("$.baseSalary.unitText")))
    week = F.when(unit == "WEEK", 52 / 12).otherwise(1.0)
    low = F.coalesce(get("$.baseSalary.value.minValue", "double"), get("$.baseSalary.value.value", "double"), get("$.baseSalary.value", "double"))
    high = F.coalesce(get("$.baseSalary.value.maxValue", "double"), get("$.baseSalary.value.value", "double"), get("$.baseSalary.value", "double"))
    until = get("$.validThrough")
    place = lambda name: F.coalesce(get(f"$.jobLocation.address.{name}"), get(f"$.jobLocation[0].address.{name}"))
    kinds = F.coalesce(get("$.employmentType", "array<string>"), F.split(get("$.employmentType"), "[,/]"))
    known = F.transform(kinds, lambda k: F.regexp_replace(F.upper(F.trim(k)), r"[\s-]+", "_"))
    return {
        "title": get("$.title"), "company": get("$.hiringOrganization.name"), "posted_at": get("$.datePosted").try_cast("timestamp"),
        "deadline_at": F.when(until.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.timestamp_seconds(F.unix_timestamp(until.try_cast("timestamp")) + 86399)).otherwise(until.try_cast("timestamp")),
        "employment_type": F.array_join(F.array_distinct(F.transform(known, lambda k: F.when(k.isin(*EMPLOYMENT), k).otherwise("OTHER"))), ","),
        "remote_type": F.when(F.upper(get("$.jobLocationType")) == "TELECOMMUTE", "remote"), "city": place("addressLocality"), "country": place("addressCountry"),
        "pay_min": low * week, "pay_max": high * week, "pay_currency": F.upper(F.coalesce(get("$.baseSalary.currency"), get("$.salaryCurrency"))),
        "pay_period": F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit), "description": get("$.description"),
    }


def requirements(node: str) -> Column:
    """The names of the places that applicants must be in, one or many, as strings or as objects with a name."""
    path = "$.applicantLocationRequirements"
    many = F.transform(F.try_variant_get(node, path, "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string")))
    one = F.coalesce(F.try_variant_get(node, f"{path}.name", "string"), F.try_variant_get(node, path, "string"))
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The fields of each structured posting of each page."""
    return nodes(pages, key, html).select(key, *[c.alias(n) for n, c in columns("node").items()])


def merge_rungs(first: dict[str, Column], second: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Fields from two sources: the first one's value wins, and keys where both differ are listed as conflicts."""
    merged = {k: F.coalesce(first[k], second[k]) for k in first}
    differ = F.array_compact(F.array(*[F.when(first[k].isNotNull() & second[k].isNotNull() & (first[k] != second[k]), F.lit(k)) for k in first]))
    return merged, differ
