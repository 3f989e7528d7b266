"""The way of work that a text states: mentions of the modes as intervals, and what takes intervals away again.

Every word that can name a mode is a mention, read with what stands in front of it and behind. A mention counts where its
surroundings speak of this job's way of work, and is taken away by an offer of two modes, by an option or permission, by a
product's name, or by what the word describes instead (other people, places, tools). The leftmost longest wording wins, so
"3 days in the office" is one mention of hybrid work and none of work on site. A mode that the text rules out is no mode.
If several modes are left, explicit statements about the role decide, if just one mode has one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.held import has, known, within
from loomfield.functions.matches import around, at_words, let
from loomfield.functions.text import says

_SITE = r"on[-\s]?site|in[-\s]?office"
#: Wording that names a mode by itself.
REMOTE_SAID = (
    r"(?i:\b(?:fully\s+remote|100%\s+remote|remote\s*[-–]?\s*first|work\s+from\s+anywhere)\b"
    r"|\bwfh\b(?!\s+(?:equipment|allowance|stipend|budget|set[-\s]?up|benefits?|policy|reimbursement))"
    r"|\b(?:based|work(?:ing)?|located)\s+remotely\b(?!\s*(?:or|and|/)\s*(?:on[-\s]?site|in[-\s]?office|hybrid|from\s+(?:the\s+|an?\s+)?office))"
    r"|\bremotely\s+(?:within|in|from|across)\b"
    r"|#\s*(?:li[-_]\s*)?remote\b|\ball[-\s]remote\b"
    r"|\b(?:can|may|will|able\s+to)\s+(?:be\s+)?(?:work(?:ed)?|done|performed|based|held)\s+remote(?:ly)?\b)"
)
HYBRID_SAID = (
    r"(?i:\b(?:\d+\s*days?\s*(?:in\s+office|on\s*site|on-site|office)|\d+\s*days?\s*a\s+week\s*(?:on\s*site|on-site|in\s+office)"
    r"|part[-\s]?time\s+office|some\s+office|office\s+\d+\s*days?)\b)"
)
ONSITE_SAID = (
    rf"(?i:\b(?:{_SITE}|work\s+from\s+office|office\s+based|must\s+work\s+(?:from|in)\s+office"
    r"|in[-\s]?person\s+(?:role|position|job|work|expectations?|presence|attendance)|work(?:ing)?\s+in[-\s]?person)\b)"
)
#: What makes the bare words "remote" and "hybrid" name a mode: delimiters on both sides, or words on one.
DELIMITED_BEFORE, DELIMITED_AFTER = r"(?:^|[(\[\n|;/–-]|,\s)\s*$", r"^\s*(?:$|[)\]\n|;/(–-]|,\s*[A-Z])"
REMOTE_BEFORE = (
    r"(?i)(?:\bis|\bare|\bbe|\bbeing|\bfully|\bentirely|\bcompletely|\ball|\bwork|\bworking|\bworks|\bhire|\bhiring|\bposition|\brole|\bjob|\blocation"
    r"|\bopportunity|\btype|\bmode|\barrangement|\bstatus|\bsetup)\s*[:\-–]?\s*(?:(?:fully|entirely|completely)\s+)?$"
)
REMOTE_AFTER = (
    r"(?i)^(?:[-\s]+(?:first|friendly|eligible|based|only|option|options|flexib\w+)"
    r"|\s+(?:work|worker|workers|role|position|job|opportunity|culture|company|organi[sz]ation|first|only|option|options|basis)\b)"
)
_ABOUT_OFFICE = r"(?=[^.]{0,80}\b(?:office|days?|week|on[-\s]?site|located|based|hub|in[-\s]?person)\b)"
HYBRID_BEFORE = r"(?i)(?:\bis|\bare|\bbe|\bwork|\bworking|\bworks|\bposition|\brole|\bjob|\blocation|\btype|\bmode|\bsetup|\barrangement)\s*[:\-–]?\s*$"
HYBRID_AFTER = (
    r"(?i)^(?:\s+(?:work(?:ing)?|model|schedule|policy|setup|set-up|arrangement|environment|office|basis|workplace|opportunity|culture|from\b)"
    rf"|\s+(?:role|position|job)\b{_ABOUT_OFFICE})"
)
#: What takes a mention away: permissions, offers of two modes, products, places, other people and things.
OPTION_BEFORE = r"(?i)(?:option|options|choice|ability|opportunity|flexibility|freedom|chance|possibility|able|allowed|permitted|eligible|encouraged)\s+(?:to|for)\s+(?:\w+\s+){0,2}$"
_MODE = r"(?:remote(?:ly)?|on[-\s]?site|in[-\s]?office|hybrid)"
EITHER = rf"(?i:\b{_MODE}\s*(?:or|/|and/or)\s*{_MODE}\b)"
PRODUCT_AFTER = r"(?i)^\.(?:com|co|io)\b"
PLACE_AFTER = r"^\s*,\s*[A-Z][a-zA-Z]+"
OTHERS_AFTER = (
    r"(?i)^[\s-]*(?:teams?|colleagues?|stakeholders?|employees?|workers?|offices?|locations?|customers?|clients?|collaboration|meetings?|support|access|sessions?|environments?"
    r"|participants?|candidates?|interviews?|learning|training|resources?|monitoring|servers?|desktops?|control|sensing|devices?|devs?|developers?|talent|staff|members?"
    r"|communication|culture\s+of\s+others|positions|roles|jobs|opportunities|options|arrangements)\b"
)
LISTED_BEFORE = r"(?i)(?:\blocal|\bboth|\band|\bor|\bon[-\s]?site|\bhybrid|\bin[-\s]?office|\bdistributed|\bco-?located)\s*[,/]?\s*$"
#: Wording that rules a mode out.
NOT_REMOTE = r"(?i)\b(?:not|no|never)\s+(?:[a-z]+\s+){0,3}?(?:fully\s+)?remote\b|\bremote\s+(?:work(?:ing)?\s+)?(?:is|are)\s+not\b|\bnon[-\s]?remote\b"
NOT_HYBRID, NOT_ONSITE = r"(?i)\bnot\s+hybrid\b", rf"(?i)\bnot\s+(?:{_SITE})\b"
REMOTE_OR_HYBRID = r"(?i)\bremote\s+(?:or|/)\s+hybrid\b"
#: Explicit statements about the role.
STRONG = {
    "remote": (
        r"(?i)\bthis\s+(?:is\s+)?(?:a\s+)?(?:fully\s+)?remote\s+(?:role|position|job|opportunity)\b|\b(?:role|position|job)\s+(?:is|will\s+be)\s+(?:fully\s+)?remote\b"
        r"|\bfully\s+remote\s+(?:role|position|job)\b|\b(?:based|work(?:ing)?|located)\s+remotely\b(?!\s*(?:or|and|/)\s*(?:on[-\s]?site|in[-\s]?office|hybrid))"
        r"|\b100%\s+remote\b|\blocation\s*:\s*remote\b|\ball\s+of\s+our\s+roles\s+are\s+remote\b"
    ),
    "hybrid": (
        rf"(?i)\bthis\s+(?:is\s+)?(?:a\s+)?hybrid\s+(?:role|position|job)\b{_ABOUT_OFFICE}|\bhybrid\s+(?:work\s+)?(?:model|schedule|basis)\b"
        r"|\b(?:role|position)\s+is\s+hybrid\b|#li[-_]hybrid\b|\b\d\s+days?\s+(?:a|per)\s+week\s+(?:in|at)\s+(?:the\s+|our\s+)?office\b|\bin\s+the\s+office\s+(?:at\s+least\s+)?\w+\s+days?\b"
    ),
    "onsite": (
        r"(?i)\bthis\s+(?:is\s+)?(?:an?\s+)?on[-\s]?site\s+(?:role|position|job)\b|\b(?:role|position)\s+is\s+(?:based\s+)?on[-\s]?site\b"
        r"|#li[-_]onsite\b|\bbased\s+(?:onsite|on[-\s]site)\b"
    ),
}
NOT_REMOTE_STRONG = (
    r"(?i)\b(?:role|position|job|this)\b[^.]{0,30}\b(?:isn't|is\s+not|not)\s+(?:a\s+)?(?:fit\s+for\s+)?(?:fully\s+)?remote\b|\bnot\s+(?:a\s+)?(?:fully\s+)?remote\s+(?:role|position|job)\b"
    r"|\bno\s+remote\s+(?:work|option|working)\b|\bisn't\s+a\s+fit\s+for\s+fully\s+remote\b"
)

#: Every mention; where several begin at one place the fuller wording is taken.
MENTION = rf"{HYBRID_SAID}|{REMOTE_SAID}|(?i:\bremote\b)|(?i:\bhybrid\b)|{ONSITE_SAID}"
#: Where a mention can begin: a cheap test in front.
MENTION_START = r"(?=#|(?<![A-Za-z])(?:[0-9]|(?i:part|some|offi|full|remot|work|wfh|base|locat|all[-\s]rem|can\s|may\s|will\s|able\s|hybr|on[-\s]?site|in[-\s]?[op]|must\s)))"

#: Words of which a text must hold one (``held``).
NAMED = known("remote remotely remotefirst wfh anywhere hybrid site onsite office inoffice person inperson dayonsite daysonsite weekonsite dayoffice daysoffice")


def _offered(m: Column) -> Column:
    """Part of an offer of two modes: one that begins inside the mention, or ends with it."""
    inside = F.regexp_instr(F.concat(m["said"], m["after"]), F.lit(EITHER))
    ends = m["before"].rlike(rf"(?i)\b{_MODE}\s*(?:or|/|and/or)\s*$") & m["said"].rlike(rf"(?i)^{_MODE}\b")
    return inside.between(1, F.length(m["said"])) | ends


def _delimited(m: Column) -> Column:
    return m["before"].rlike(DELIMITED_BEFORE) & m["after"].rlike(DELIMITED_AFTER)


def _mode(m: Column) -> Column:
    """The mode that a mention states, or null."""
    said = F.lower(m["said"])
    bare = said == "remote"
    in_context = _delimited(m) | m["before"].rlike(REMOTE_BEFORE) | m["after"].rlike(REMOTE_AFTER)
    other = m["after"].rlike(PRODUCT_AFTER) | m["after"].rlike(PLACE_AFTER) | m["after"].rlike(OTHERS_AFTER) | m["before"].rlike(LISTED_BEFORE)
    remote = ~m["before"].rlike(OPTION_BEFORE) & ~_offered(m) & (~bare | (in_context & ~other))
    hybrid = _delimited(m) | m["before"].rlike(HYBRID_BEFORE) | m["after"].rlike(HYBRID_AFTER)
    return (
        F.when(said == "hybrid", F.when(hybrid, "hybrid"))
        .when(bare | said.rlike(rf"^{REMOTE_SAID}"), F.when(remote, "remote"))
        .when(said.rlike(rf"^{HYBRID_SAID}"), "hybrid")
        .otherwise(F.when(~_offered(m), "onsite"))
    )


def work_mode(text: Column, words: Column | None = None) -> Column:
    """remote, hybrid or onsite, if a text states one for its job. Whole texts are read. ``words``: what the text holds, if that is
    known (``held``)."""
    own = F.coalesce(text, F.lit(""))
    stated = F.array_distinct(F.array_compact(F.transform(around(own, MENTION, 45, 90, start=MENTION_START), _mode)))

    by_mode = lambda m, patterns: F.coalesce(*[F.when(m == k, own.rlike(p)) for k, p in patterns.items()])

    def decided(left: Column) -> Column:
        several = F.when(~own.rlike(REMOTE_OR_HYBRID), let(F.filter(left, lambda m: by_mode(m, STRONG)), lambda s: F.when(F.size(s) == 1, F.get(s, 0))))
        return F.when(F.size(left) == 1, F.get(left, 0)).when(F.size(left) > 1, several)

    found = let(F.filter(stated, lambda m: ~by_mode(m, {"remote": at_words(NOT_REMOTE), "hybrid": at_words(NOT_HYBRID), "onsite": at_words(NOT_ONSITE)})), decided)
    return within(words, own, lambda w: F.when(has(w, NAMED) & says(own, "remote", "wfh", "anywhere", "hybrid", "site", "office", "person"), found))


def refuses_remote(text: Column) -> Column:
    """The text says that this role is not remote, whatever the board says."""
    own = F.coalesce(text, F.lit(""))
    return says(own, "remote") & own.rlike(at_words(NOT_REMOTE_STRONG))


def not_for_remote(text: Column) -> Column:
    """An explicit statement of hybrid work or work on site, with none of remote work beside it."""
    own = F.coalesce(text, F.lit(""))
    return says(own, "hybrid", "site", "office") & (own.rlike(STRONG["hybrid"]) | own.rlike(STRONG["onsite"])) & ~own.rlike(STRONG["remote"])
