"""Fit scores of postings for a profile: points by part, total, bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most points by part, weights of skills, thresholds.
MOST = {"skills": 40, "role": 25, "level": 15, "place": 10, "eligibility": 10, "pay": 5, "freshness": 5}
#: In whole hundredths, so that sums don't depend on their order.
MUST, NICE, MUST_GENERAL, NICE_GENERAL = 100, 40, 25, 10
FULL_CREDIT, LEAST_SKILLS = 0.8, 3
BLOCKED_CAP, STRONG, WORTH, CANDIDATES = 25, 65, 40, 400
SENIOR = ("senior", "lead", "staff", "principal", "director")


def skill_points(asked: DataFrame, mine: DataFrame, key: str) -> DataFrame:
    """(key, n_skills, points) from (key, skill, importance, general) and the skills of a profile."""
    known = mine.select("skill").distinct().withColumn("_mine", F.lit(True))
    must, general = F.col("importance") == "must", F.col("general")
    weight = F.when(must & general, MUST_GENERAL).when(must, MUST).when(general, NICE_GENERAL).otherwise(NICE)
    rows = asked.join(known, "skill", "left").withColumn("_w", weight)
    sums = rows.groupBy(key).agg(F.count("*").alias("n_skills"), F.sum("_w").alias("_total"), F.sum(F.when(F.col("_mine"), F.col("_w")).otherwise(0)).alias("_covered"))
    points = F.round(MOST["skills"] * F.least(F.lit(1.0), F.col("_covered") / F.col("_total") / FULL_CREDIT), 1)
    return sums.select(key, "n_skills", F.when(F.col("n_skills") >= LEAST_SKILLS, points).alias("points"))


def text_skill_points(text: Column, skills: list[str]) -> Column:
    """Points where a posting has no stored skills: how many of the profile's first six it names."""
    from loomfield.functions.text import word_pattern

    hits = sum((F.lower(text).rlike(word_pattern(s.lower())).cast("int") for s in skills), F.lit(0))
    return F.round(MOST["skills"] * F.least(F.lit(1.0), hits / min(len(skills), 6)), 1)


def role_points(title: Column, roles: list[str], family: Column, families: list[str]) -> Column:
    """Full for a target role in the title, half for at least half of its words, four fifths for a chosen family."""
    import re

    from loomfield.functions.text import word_pattern

    low, shares = F.lower(title), [F.lit(0.0)]
    for role in roles:
        words = [w for w in re.split(r"[^\w+#]+", role.lower()) if len(w) > 2 and w not in ("and", "the", "for", "with")]
        if words:
            matched = sum((low.rlike(word_pattern(w)).cast("int") for w in words), F.lit(0))
            shares.append(F.when(low.rlike(word_pattern(role.lower())), 1.0).when(matched / len(words) >= 0.5, 0.5).otherwise(0.0))
    best = F.greatest(F.lit(0.0), *shares)
    return F.round(MOST["role"] * F.when(F.coalesce(family.isin(families), F.lit(False)) & (best < 0.8), 0.8).otherwise(best), 1)


def level_points(seniority: Column, least_years: Column, mine: float) -> Column:
    return (
        F.when(seniority.isin(*SENIOR), 0.0).when(seniority.isin("intern", "entry"), float(MOST["level"]))
        .when(least_years.isNotNull(), F.when(least_years <= mine + 1, float(MOST["level"])).otherwise(0.0))
    )


def place_points(remote_type: Column, places: Column, remote_ok: bool, wanted: list[str], countries: list[str]) -> Column:
    """Full for remote work if one is open to it, and for a place one named; six tenths for a country one can work in; null
    if no place is stated. ``places``: array of structs with raw and country."""
    most = float(MOST["place"])
    named = F.exists(places, lambda p: F.exists(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.contains(F.lower(p["raw"]), w)))
    inside = F.exists(places, lambda p: p["country"].isin(countries))
    return (
        F.when(remote_type.eqNullSafe("remote"), most if remote_ok else 0.0).when(F.coalesce(named, F.lit(False)), most)
        .when(F.size(places) > 0, F.when(F.coalesce(inside, F.lit(False)), most * 0.6).otherwise(0.0))
    )


def eligibility_points(scope: Column, countries: Column, mine: list[str]) -> Column:
    ok = F.arrays_overlap(countries, F.array(*[F.lit(c) for c in mine]))
    return F.when(scope == "worldwide", float(MOST["eligibility"])).when(F.size(countries) > 0, F.when(ok, float(MOST["eligibility"])).otherwise(0.0))


def freshness(hours: Column) -> Column:
    most = float(MOST["freshness"])
    return F.when(hours.isNull() | (hours < 0), None).when(hours <= 48, most).when(hours <= 168, most * 0.6).when(hours <= 720, most * 0.3).otherwise(0.0)


def total(parts: dict[str, Column], blocked: Column) -> Column:
    """Points over the most of the parts that were judged (not null), as whole percent; blocked postings are capped."""
    zero = F.lit(0.0)
    points = sum((F.coalesce(c, zero) for c in parts.values()), zero)
    most = sum((F.when(c.isNull(), 0).otherwise(MOST[k]) for k, c in parts.items()), F.lit(0))
    score = F.when(most > 0, F.floor(points / most * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    return F.when(blocked, F.least(score, F.lit(BLOCKED_CAP).cast("long"))).otherwise(score)


def bucket(score: Column, blocked: Column, reachable: Column, stretch: Column) -> Column:
    return F.when(blocked, "other").when((score >= STRONG) & reachable, "strong").when((score >= WORTH) | stretch, "worth").otherwise("other")
