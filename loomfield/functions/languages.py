"""Languages that a posting asks for, and those it only welcomes. Texts are read whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.held import has, known, within
from loomfield.functions.matches import WORD, around, at_words, let
from loomfield.functions.text import holds, says

#: Languages that postings name.
LANGUAGES = (
    "german french spanish portuguese italian dutch japanese korean mandarin cantonese chinese arabic russian turkish vietnamese thai indonesian swedish norwegian danish finnish czech hebrew greek hungarian romanian "
    "ukrainian hindi tamil telugu kannada malayalam marathi bengali gujarati punjabi urdu odia"
).split()

#: Words of which a text must hold one (``held``).
NAMED, NAMED_POLISH = known(*LANGUAGES), known("polish")

#: Wording that asks for a language (LANG stands for its name).
REQUIRED = (
    r"(?i:\b(?:fluen(?:t|cy)|native|bilingual|proficien(?:t|cy)|mother\s+tongue|speaker\s+of|speak(?:ing)?|written\s+and\s+spoken|spoken\s+and\s+written)\s+(?:[\w-]+\s+){0,3}?LANG\b)",
    r"(?i:\bLANG\b\s+(?:language\s+)?(?:fluency|proficiency|skills?|speaker|speaking|native|is\s+(?:required|mandatory|a\s+must|essential)|required|mandatory|a\s+must|essential)\b)",
    r"(?i:\bLANG\b\s*(?:[-:(]\s*)?(?:level\s*)?(?:[ABC][12]|N[1-3]|HSK\s*[3-6])\b)",
    r"(?i:\bLANG[- ]speaking\s+(?:[\w-]+\s+){0,2}?(?:agents?|associates?|representatives?|specialists?|executives?|support|candidates?|analysts?|managers?|engineers?|professionals?|advisors?|consultants?|moderators?|writers?|recruiters?|roles?|positions?|jobs?)\b)",
    r"(?i:\bLANG\s+(?:speaker|support|specialist)\b)",
    r"(?i:\bLANG\s+(?:language\s+)?(?:interpreters?|translators?|transcri\w+|linguists?|annotators?|tutors?|teachers?)\b)",
    r"(?i:\blanguages?\s*[:\-]\s*(?:[\w/&-]+[\s,]+){0,3}?LANG\b)",
    r"(?i:\b(?:good|working|strong|excellent|advanced|business|professional|solid|intermediate)\s+(?:level\s+of\s+|command\s+of\s+|knowledge\s+of\s+|proficiency\s+in\s+)?LANG\b"
    r"(?!\s+(?:gaap|tax|law|laws|market|markets|regulat\w+|labou?r|accounting|standards?|culture|customers?|companies|clients?|business|rules?|cuisine|history|literature)))",
)
#: Words of which a text must hold one, in either case, for each of these to find something.
_HOLDS = (
    ("fluen", "native", "bilingual", "proficien", "mother", "speak", "spoken"), ("fluency", "proficiency", "skill", "speak", "native", "required", "mandatory", "must", "essential"),
    ("a1", "a2", "b1", "b2", "c1", "c2", "n1", "n2", "n3", "hsk"), ("speaking",), ("speaker", "support", "specialist"), ("interpreter", "translator", "transcri", "linguist", "annotator", "tutor", "teacher"),
    ("language",), ("good", "working", "strong", "excellent", "advanced", "business", "professional", "solid", "intermediate"),
)
#: The one language whose name is a verb too, so that only the capitalised word counts.
POLISH = r"(?:(?i:\b(?:fluen\w+|native|proficien\w+|speak\w*|bilingual))\s+(?:[\w-]+\s+){0,3}?Polish\b|\bPolish\s+(?i:language|speaker|fluency|required|mandatory)\b)"
#: Wording that makes a language optional: beside its name, behind a match, in front of one.
NICE_ONLY = r"(?i)\b(LANG)\b[^.\n]{0,15}?\b(?:is\s+)?(?:a\s+plus|an?\s+(?:advantage|bonus|asset)|nice[- ]to[- ]have|preferred|desirable|beneficial)\b"
_WELCOME = ("plus", "advantage", "bonus", "asset", "nice", "preferred", "desirable", "beneficial")
NICE_AFTER = (
    r"(?i)^[^.\n]{0,40}\b(?:is\s+)?(?:a\s+plus|an?\s+(?:advantage|bonus|asset)|nice[- ]to[- ]have|preferred|desirable|beneficial|not\s+required|optional"
    r"|helpful|useful|welcome|would\s+(?:be\s+)?(?:helpful|an?\s+advantage|beneficial|great|nice|useful)|would\s+set\s+you\s+up\s+for\s+success)\b"
)
NICE_BEFORE = r"(?i)\b(?:plus|bonus|nice[- ]to[- ]have|preferred|desirable|advantage|beneficial|optional)\b[^.\n]{0,30}$"


def languages(text: Column, words: Column | None = None) -> Column:
    """struct(required, nice): sorted names. What is asked for anywhere is not merely nice; null texts ask for none.
    ``words``: what the text holds, if that is known (``held``)."""
    names, none = "|".join(LANGUAGES), F.expr("cast(array() as array<struct<name: string, nice: boolean>>)")

    def named(low: Column) -> Column:
        found = []
        for pattern, words in zip(REQUIRED, _HOLDS, strict=True):
            hits = around(text, pattern.replace("LANG", f"({names})"), 40, 60, groups=1, test=pattern.replace("LANG", f"(?:{names})"), start=WORD)
            found.append(F.when(holds(low, *words), F.transform(hits, lambda m: _asked(F.lower(m["g1"]), m))).otherwise(none))
        optional = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(at_words(NICE_ONLY).replace("LANG", names)), F.lit(1))
        welcome = F.when(holds(low, *_WELCOME), F.transform(optional, lambda x: F.struct(F.lower(x).alias("name"), F.lit(True).alias("nice")))).otherwise(none)
        return F.when(holds(low, *LANGUAGES), F.concat(*found, welcome)).otherwise(none)

    def every(w: Column) -> Column:
        polish = F.when(has(w, NAMED_POLISH) & says(text, "polish"), F.transform(around(text, POLISH, 40, 60, start=WORD), lambda m: _asked(F.lit("polish"), m))).otherwise(none)
        return F.concat(F.when(has(w, NAMED), let(F.lower(F.coalesce(text, F.lit(""))), named)).otherwise(none), polish)

    def sorted_out(every: Column) -> Column:
        pick = lambda nice: F.transform(F.filter(every, lambda x: x["nice"] == nice), lambda x: x["name"])
        return F.struct(F.array_sort(F.array_distinct(pick(False))).alias("required"), F.array_sort(F.array_except(pick(True), pick(False))).alias("nice"))

    return let(within(words, text, every), sorted_out)


def _asked(name: Column, m: Column) -> Column:
    return F.struct(name.alias("name"), (m["after"].rlike(NICE_AFTER) | m["before"].rlike(NICE_BEFORE)).alias("nice"))
