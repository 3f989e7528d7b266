"""Who may take a job, and from where: wording of texts and titles, and the stated requirements of structured postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions import geo
from loomfield.functions.held import ODD, has, known, within
from loomfield.functions.matches import WORD, around, at_words, let
from loomfield.functions.text import holds, says

#: Wording near which a country or region is a requirement, and claims that a job is open to all.
CUES = r"(?i)\bonly\b|\bmust\b|\bbased\s+in\b|\blocated\s+in\b|\bopen\s+to\b|\beligible\b|\bresidents?\s+of\b|\bcitizens?\b|\bauthorized\s+to\s+work\s+in\b|\bhiring\s+in\b|\bcandidates?\s+in\b"
_NO_COMPANY = r"\b(?!-|\s+(?:first|company|culture|team|organi[sz]ation|workforce))"
WORLDWIDE = (
    r"(?i:\bwe\s+(?:are\s+)?hir(?:e|ing)\s+(?:[a-z-]+\s+){0,3}(?:worldwide|globally|anywhere(?:\s+in\s+the\s+world)?)\b"
    r"|\bwork(?:ing)?\s+(?:remotely\s+)?from\s+anywhere\s+in\s+the\s+world\b"
    rf"|\bglobal\s+remote{_NO_COMPANY}|\bworldwide\s+remote{_NO_COMPANY}"
    r"|\bremote\s+(?:role|position|job|opportunity)?\s*[-,(]?\s*worldwide\b"
    r"|\bopen\s+to\s+(?:candidates|applicants)\s+(?:from\s+)?(?:anywhere|worldwide|globally)\b"
    r"|\b(?:candidates|applicants)\s+(?:from|in)\s+anywhere\b)"
)
WORLDWIDE_BARE = r"(?i)^\W*(?:anywhere(?:\s+in\s+(?:the\s+)?world)?|worldwide|global(?:ly)?|work\s+from\s+anywhere)\W*$"
EXCEPTION = r"(?i)\b(?:except|excluding|exclude[sd]?|other\s+than|apart\s+from|with\s+the\s+exception\s+of|but\s+not|not\s+(?:in|from|available\s+in)|outside\s+of)\b"
EU_ONLY = r"(?i)\b(?:within\s+the\s+eu|eu\s+only|european\s+union\s+only)\b"
NOT_OUTSIDE = r"(?i)\bnot\s+open\s+to\s+candidates?\s+outside\s+(?:(?:the|of)\s+)?([A-Za-z][A-Za-z .'-]{1,50})\b"
REMOTE_PLACE = r"(?i)remote\s*[-–:(]\s*([A-Za-z][A-Za-z .',-]{1,100})"
#: Words that name regions in texts.
REGION_WORDS = ("european union", "latin america", "north america", "asia-pacific", "asia pacific", "europe", "emea", "apac", "latam", "eu")

#: Stated requirements that are no country: everywhere, and names of regions.
EVERYWHERE = ("worldwide", "world wide", "anywhere in the world", "anywhere", "global", "globally")
REGION_NAMES = (
    "apac", "asia-pacific", "asia pacific", "emea", "europe", "european union", "eu", "latam", "latin america", "north america", "south america",
    "middle east", "africa", "mena", "global", "worldwide",
)

#: Labels of permits that wording asks for, and wording around them that takes the demand back.
PERMITS = {
    "us_work_authorization": r"(?i:\bauthori[sz]ed\s+to\s+work\s+in\s+the\s+(?:us|u\.s\.|usa|united\s+states)\b|\bus\s+work\s+authori[sz]ation\b|\bus\s+citizens?\b|\bu\.s\.\s+citizens?\b|\be-?verify\b)",
    "uk_right_to_work": r"(?i:\bright\s+to\s+work\s+in\s+the\s+uk\b|\buk\s+right\s+to\s+work\b)",
    "eu_work_permit": r"(?i:\b(?:eu\s+work\s+permit|right\s+to\s+work\s+in\s+the\s+eu)\b)",
    "india_work_permit": r"(?i:\bindia(?:n)?\s+work\s+(?:permit|authori[sz]ation)\b)",
    "security_clearance": r"(?i:\b(?:security\s+clearance|ts/sci|top\s+secret)\b)",
    "citizenship": r"(?i:\b(?:us|u\.s\.|uk|eu)?\s*citizens?\s+only\b|\bcitizenship\s+(?:is\s+)?required\b)",
}
#: Words of which a text must hold one, in either case, for each of these to be asked for.
PERMIT_ANCHORS = {
    "us_work_authorization": ("authori", "citizen", "verify"), "uk_right_to_work": ("right",), "eu_work_permit": ("permit", "right"), "india_work_permit": ("permit", "authori"),
    "security_clearance": ("clearance", "ts/sci", "secret"), "citizenship": ("citizen",),
}
#: Citizenship may begin with the white space behind another word.
_CITIZEN_START = r"(?=[\suUeEcC])"
NO_BEFORE = r"(?i)(?:\bno\b|\bnot\b|\bnever\b|\bwithout\b|\bdon't\b|\bdo\s+not\b|\bdoesn't\b|\bdoes\s+not\b|\bisn't\b|\bneedn't\b|\bno\s+need\s+(?:to\s+be|for)\b)[^.;!?\n]{0,30}$"
NO_AFTER = r"(?i)^[^.;!?\n]{0,25}\b(?:is\s+|are\s+)?(?:not|never)\s+(?:required|needed|necessary|a\s+requirement|mandatory)\b|^[^.;!?\n]{0,25}\b(?:isn't|aren't)\s+(?:required|needed|necessary)\b|^\s*(?:is\s+)?optional\b"
CONDITION_BEFORE = r"(?i)\b(?:who|that|if\s+you|applicants?|candidates?)\s+(?:are|is|do|does)\s+not\b[^.;!?\n]{0,30}$"
INDIANS_ONLY, AMERICANS_ONLY = r"(?i)\bindian?\s+(?:citizens?|nationals?)\s+only\b", r"(?i)\b(?:us|u\.s\.)\s+citizens?\s+only\b"

_NONE = "cast(array() as array<string>)"
_LISTED = sorted(k for k in geo.COUNTRIES if k not in ("uk", "usa", "u.s."))
#: Words of which a text must hold one (``held``): of names of several words, the last.
NAMED_WORLD, NAMED_OUTSIDE, NAMED_EU = known("worldwide global globally anywhere roleworldwide positionworldwide jobworldwide opportunityworldwide"), known("outside"), known("eu union")
NAMED_PLACE, NAMED_REGION = known("us usa uk", *[k.split()[-1] for k in _LISTED]) + ODD, known(*[k.replace("-", " ").split()[-1] for k in REGION_WORDS]) + ODD
NAMED_PERMIT = known(
    "authorised authorized authorisation authorization citizen citizens verify everify right permit clearance sci secret citizenship uscitizen uscitizens ukcitizen ukcitizens eucitizen eucitizens"
)


def matches(text: Column, pattern: str, start: str = WORD) -> Column:
    """Array of (said, before, after, onward): each match with 40 characters in front, 45 behind, and the 40 that begin with it."""
    found = around(text, pattern, 40, 45, start=start)
    return F.transform(found, lambda m: F.struct(m["said"].alias("said"), m["before"].alias("before"), m["after"].alias("after"), F.left(F.concat(m["said"], m["after"]), F.lit(40)).alias("onward")))


def _near_cue(m: Column) -> Column:
    return F.concat(m["before"], m["onward"]).rlike(CUES)


def _names(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


def eligibility(text: Column, words: Column | None = None) -> Column:
    """struct(countries, scope) that a text states: worldwide (unless the sentence goes on to an exception, then nothing),
    "not open to candidates outside", the EU, "Remote - Canada or Mexico", and countries or regions close to a cue. Null fields
    are unknown. ``words``: what the text holds, if that is known (``held``)."""
    own = F.coalesce(text, F.lit(""))
    place = lambda countries, scope: F.struct(countries.alias("countries"), F.lit(scope).cast("string").alias("scope"))
    none, empty = F.lit(None).cast("array<string>"), F.expr(_NONE)
    world = says(own, "worldwide", "global", "anywhere") & (own.rlike(at_words(WORLDWIDE)) | ((F.length(own) <= 60) & own.rlike(WORLDWIDE_BARE)))
    rest = F.regexp_extract(own, rf"(?s){at_words(WORLDWIDE)}([^.;!?\n]{{0,120}})", 1)
    outside = F.when(says(own, "outside"), let(F.regexp_extract(own, at_words(NOT_OUTSIDE), 1), lambda x: geo.country_code(F.trim(x))))

    places = F.when(says(own, "remote"), F.regexp_extract_all(own, F.lit(REMOTE_PLACE), F.lit(1))).otherwise(empty)
    parts = F.transform(places, lambda p: F.filter(F.transform(F.split(p, r"\s*(?:\bor\b|,|/|\|)\s*"), lambda x: F.trim(x)), lambda x: x != ""))
    coded = F.transform(parts, lambda p: F.transform(p, geo.country_code))
    stated = F.flatten(F.filter(coded, lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())))
    lower = F.coalesce(matches(own, rf"(?iU:\b(?:{_names(_LISTED)})\b)"), F.array())
    upper = F.coalesce(matches(own, r"\b(?:USA|US|UK)\b"), F.array())
    code = {"US": "US", "USA": "US", "UK": "GB"}
    by_upper = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    named = F.transform(F.filter(lower, _near_cue), lambda m: geo.country_code(m["said"]))
    capitals = F.transform(F.filter(upper, _near_cue), lambda m: F.try_element_at(by_upper, m["said"]))
    countries = F.array_sort(F.array_distinct(F.array_compact(F.concat(stated, named, capitals))))
    bare = F.lower(F.btrim(own, F.lit(" \t\n\x0b\f\r.,;:()[]")))
    regions = bare.isin(*REGION_WORDS) | F.coalesce(F.exists(matches(own, rf"(?iU:\b(?:{_names(REGION_WORDS)})\b)"), _near_cue), F.lit(False))
    has_place = says(own, "remote", *_LISTED) | own.rlike(at_words(r"\bUSA?\b|\bUK\b"))
    stated_in = lambda w: F.coalesce(
        F.when(has(w, NAMED_WORLD) & world, F.when(rest.rlike(EXCEPTION), place(none, None)).otherwise(place(empty, "worldwide"))),
        let(F.when(has(w, NAMED_OUTSIDE), outside), lambda code: F.when(code.isNotNull(), place(F.array(code), "countries"))),
        F.when(has(w, NAMED_EU) & says(own, "the eu", "eu only", "union only") & own.rlike(at_words(EU_ONLY)), place(F.array(*[F.lit(c) for c in sorted(geo.EU)]), "countries")),
        let(F.when((has(w, NAMED_PLACE) | says(own, "remote")) & has_place, countries), lambda listed: F.when(F.size(listed) > 0, place(listed, "countries"))),
        F.when(has(w, NAMED_REGION) & says(own, *REGION_WORDS) & regions, place(none, "regions")).otherwise(place(none, None)),
    )
    return within(words, own, stated_in)


def permits(text: Column, words: Column | None = None) -> Column:
    """Sorted labels of the permits that a text asks for. A demand that is taken back, in front or behind, is none, but "who are
    not authorized to work in the US" still is one. Indian citizens only is a permit for India, US ones imply the US permit.
    ``words``: what the text holds, if that is known (``held``)."""
    own = F.coalesce(text, F.lit(""))
    affirmed = lambda m: m["before"].rlike(CONDITION_BEFORE) | ~(m["before"].rlike(NO_BEFORE) | m["after"].rlike(NO_AFTER))

    def asked(low: Column) -> Column:
        said = {k: F.exists(matches(own, pattern, _CITIZEN_START if k == "citizenship" else WORD), affirmed) for k, pattern in PERMITS.items()}
        return F.struct(*[(holds(low, *PERMIT_ANCHORS[k]) & c).alias(k) for k, c in said.items()])

    def listed(x: Column) -> Column:
        found, citizens = {label: x[label] for label in PERMITS}, x["citizenship"]
        indians = citizens & own.rlike(at_words(INDIANS_ONLY))
        found["india_work_permit"] = found["india_work_permit"] | indians
        found["us_work_authorization"] = found["us_work_authorization"] | (citizens & ~indians & own.rlike(at_words(AMERICANS_ONLY)))
        found["citizenship"] = citizens & ~indians
        return F.array_sort(F.array_compact(F.array(*[F.when(f, F.lit(label)) for label, f in found.items()])))

    return within(words, own, lambda w: F.when(has(w, NAMED_PERMIT), let(let(F.lower(own), asked), listed)).otherwise(F.expr(_NONE)))


def applicant_requirements(names: Column) -> Column:
    """struct(countries, scope) of the places that a structured posting says applicants must be in (array of names). Countries
    win over regions, worldwide counts only alone, and what is neither is ignored."""
    low = F.transform(F.filter(F.coalesce(names, F.expr(_NONE)), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    world = F.exists(low, lambda x: F.lower(x).isin(*EVERYWHERE))
    region = F.exists(low, lambda x: F.lower(x).isin(*REGION_NAMES) & ~F.lower(x).isin(*EVERYWHERE))
    countries = F.array_distinct(F.array_compact(F.transform(low, geo.country_code)))
    some = F.size(countries) > 0
    scope = F.when(some, "countries").when(region, "regions").when(world, "worldwide")
    return F.struct(F.when(some, countries).alias("countries"), scope.alias("scope"))


def title_segments(title: Column) -> Column:
    """Parts of a title that state a remote place, in brackets or behind a dash or bar: "(Remote - India)", "- EMEA Remote"."""
    own, part = F.coalesce(title, F.lit("")), r"[(\[]([^)\]]{3,60})[)\]]|\s[-–—|]\s([^()\[\]|]{3,60})$"
    both = F.zip_with(F.regexp_extract_all(own, F.lit(part), F.lit(1)), F.regexp_extract_all(own, F.lit(part), F.lit(2)), lambda a, b: F.trim(F.when(a != "", a).otherwise(b)))
    return F.array_distinct(F.filter(both, lambda s: s.rlike(r"(?i)\bremote\b")))


#: What boards put where a place belongs, though it only names the way of work.
MODE_LABELS = {
    "in-office": "onsite", "in office": "onsite", "office": "onsite", "office-based": "onsite", "on-site": "onsite", "onsite": "onsite", "on site": "onsite",
    "in-person": "onsite", "in person": "onsite", "hybrid": "hybrid",
}


def mode_of_places(places: Column) -> Column:
    """The way of work, if every place (array of strings) only names one and all name the same; else null."""
    table = F.create_map(*[F.lit(x) for kv in MODE_LABELS.items() for x in kv])
    modes = F.transform(places, lambda p: F.try_element_at(table, F.trim(F.regexp_replace(F.lower(p), r"\s+", " "))))
    return F.when((F.size(places) > 0) & F.forall(modes, lambda m: m.isNotNull()) & (F.size(F.array_distinct(modes)) == 1), F.get(modes, 0))
