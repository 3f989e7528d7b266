"""Text columns: titles, names, links, redaction, formatting, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.matches import let


def says(text: Column, *anchors: str) -> Column:
    """Whether a text holds one of some lower-case strings, in either case: a cheap test in front of a pattern."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: holds(low, *anchors))


def holds(low: Column, *anchors: str) -> Column:
    """``says`` for a text that is in lower case already."""
    out = F.lit(False)
    for a in anchors:
        out = out | F.contains(low, F.lit(a))
    return out


def normalize_title(c: Column) -> Column:
    """Lower case; letters, digits, underscores, spaces and + # . stay; white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s+#.]", " "), r"\s+", " "))


def normalize_company(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def split_source_id(c: Column) -> Column:
    """What follows the first slash; the whole key without one, or if nothing follows."""
    rest = F.expr("substring({0}, instr({0}, '/') + 1)".format(c)) if isinstance(c, str) else F.substring(c, F.instr(c, "/") + 1, F.length(c))
    return F.when((F.instr(c, "/") > 0) & (rest != ""), rest).otherwise(c)


def clean(c: Column) -> Column:
    """Without NUL characters."""
    return F.replace(c, F.lit("\x00"), F.lit(""))


def safe_http_url(c: Column) -> Column:
    """The link if it is http or https, else null."""
    return F.when(c.rlike(r"^(?i:https?)://[^/?#\s]+"), c)


def like_pattern(text: str) -> str:
    """An ILIKE pattern that finds the text itself anywhere."""
    return "%" + "".join("\\" + x if x in "\\%_" else x for x in text) + "%"


#: What is redacted, in order, and what stands in its place.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED]"),
    (r"(?i)Bearer\s+[A-Za-z0-9._\-~+/=]+", "Bearer [REDACTED]"),
    (r"(?i)([?&](?:token|key|secret|auth)[^=]*=)[^\s&;]+", "$1[REDACTED]"),
    (r"(?i)(token|api[_-]?key|secret|auth)\s*=\s*[^\s&;]+", "[REDACTED]"),
)


#: What a text must hold, in either case, for each of these to find something.
_HOLDS = (("@",), ("bearer",), ("=",), ("=",))


def redact(c: Column) -> Column:
    for (pattern, instead), anchors in zip(REDACTIONS, _HOLDS, strict=True):
        c = F.when(says(c, *anchors), F.regexp_replace(c, pattern, instead)).otherwise(c)
    return c


#: Function words of English, and of the other languages.
STOPWORDS = (
    "the and to of a in for with is you we will are on as be our your or an at by that this from have has can it its not "
    "who their they about more work team role experience skills"
).split()
FOREIGN_WORDS = (
    "der die das und ist wir nicht dich du ihr sie ein eine mit auf bei für den dem des zu ich dein deine unsere werden "
    "le les des du une est pour dans nous vous que qui sur avec ne pas au aux el los las del por para con una es se su sus y "
    "como más pero um uma os as dos das em não você nós il lo gli di che per con una sono non nel della het een van en te is zijn "
    "voor met niet op"
).split()


def language_counts(c: Column) -> dict[str, Column]:
    """Words, letters, letters beyond Latin scripts, English and foreign function words of a text."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    low = F.transform(words, F.lower)
    members = lambda known: F.size(F.filter(low, lambda w: w.isin(sorted(set(known)))))
    joined = F.array_join(words, "")
    return {"words": F.size(words), "letters": F.length(joined), "non_latin": F.length(F.regexp_replace(joined, r"[\x{0000}-\x{024F}]", "")), "english": members(STOPWORDS), "foreign": members(FOREIGN_WORDS)}


def counted(c: Column) -> Column:
    """``language_counts`` as one struct, whose words are taken from the text once."""
    members = lambda low, known: F.size(F.filter(low, lambda w: w.isin(sorted(set(known)))))

    def of_words(words: Column) -> Column:
        letters = let(F.array_join(words, ""), lambda j: F.struct(F.length(j).alias("all"), F.length(F.regexp_replace(j, r"[\x{0000}-\x{024F}]+", "")).alias("non_latin")))
        known = let(F.transform(words, F.lower), lambda low: F.struct(members(low, STOPWORDS).alias("english"), members(low, FOREIGN_WORDS).alias("foreign")))
        both = F.struct(F.size(words).alias("words"), letters.alias("l"), known.alias("k"))
        return let(both, lambda b: F.struct(b["words"].alias("words"), b["l"]["all"].alias("letters"), b["l"]["non_latin"].alias("non_latin"), b["k"]["english"].alias("english"), b["k"]["foreign"].alias("foreign")))

    return let(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), of_words)


def is_non_english(words: Column, letters: Column, non_latin: Column, english: Column, foreign: Column) -> Column:
    """From ``language_counts``: another script, clearly another European language, or a longer text with hardly any
    English function words. Too short a text is never judged."""
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    script = (letters >= 80) & (share(non_latin, letters) > 0.3)
    other = (words >= 15) & (share(english, words) < 0.08) & (share(foreign, words) >= 0.15)
    return script | other | ((words >= 60) & (share(english, words) < 0.12))


def format_posted(at: Column, now: Column) -> Column:
    """today, 3d ago, 2w ago, 5mo ago; null without a date."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(at.isNull(), None).when(days <= 0, "today").when(days < 14, ago(days, "d")).when(days < 60, ago(days / 7, "w")).otherwise(ago(days / 30, "mo"))


def format_lakh(low: Column, high: Column) -> Column:
    """Yearly rupee pay in lakhs: a range, one value, or an open end; null without either. Hundredths are rounded as doubles."""
    lakh = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.round(c / 100000 * 100) / 100), r"0+$", ""), r"\.$", "")
    rupee = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low != high), rupee("₹", lakh(low), "–", lakh(high), " LPA"))
        .when(low.isNotNull() & high.isNull(), rupee("from ₹", lakh(low), " LPA"))
        .when(low.isNull() & high.isNotNull(), rupee("up to ₹", lakh(high), " LPA"))
        .when(low.isNotNull(), rupee("₹", lakh(low), " LPA"))
    )


def share(part: Column, whole: Column) -> Column:
    """A share as whole percent, "73%"; a dash without a whole."""
    return F.when(whole > 0, F.concat(F.floor(part * 100 / whole + 0.5).cast("string"), F.lit("%"))).otherwise("–")


def initials(name: Column) -> Column:
    """Two-letter mark of a name: first letters of its first two words, or its first two letters."""
    words = F.filter(F.split(F.regexp_replace(name, r"[^A-Za-z0-9 ]", " "), " +"), lambda w: w != "")
    return F.upper(F.when(F.size(words) >= 2, F.concat(F.left(F.get(words, 0), F.lit(1)), F.left(F.get(words, 1), F.lit(1)))).otherwise(F.left(F.get(words, 0), F.lit(2))))


def clean_note(c: Column, most: int) -> Column:
    """Control characters become spaces, white space collapses, and the note is cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), F.lit(most))


#: Seconds by unit; a month is 30 days.
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}


def resolve_relative_date(c: Column, reference: Column) -> Column:
    """"today", "closes in 5 days", "2 weeks ago" against a reference time; null if nothing is stated."""
    low = F.trim(F.lower(c))
    units = "|".join(UNIT_SECONDS)
    amount = lambda p: F.regexp_extract(low, p, 1).try_cast("long")
    seconds = lambda p: amount(p) * F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv]), F.regexp_extract(low, p, 2))
    ahead, back = rf"\bin\s+(\d+)\s+({units})s?\b", rf"\b(\d+)\s+({units})s?\s+ago\b"
    shift = F.when(low == "today", 0).when(low == "tomorrow", 86400).when(low == "yesterday", -86400).when(low.rlike(back), -seconds(back)).when(low.rlike(ahead), seconds(ahead))
    return reference + F.make_dt_interval(secs=shift.cast("decimal(18,6)"))


def canonical_json(c: Column) -> Column:
    """JSON with the keys of all objects in order and without white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(c))


def payload_hash(c: Column) -> Column:
    """Digest of a payload that does not depend on the order of its keys."""
    return F.sha2(canonical_json(c), 256)


def report_parts(reason: Column) -> tuple[Column, Column]:
    """(field, note) of a stored report, "field=pay; too low"; other reports are notes on "other"."""
    form = r"(?s)^field=([a-z]+);\s*(.*)$"
    return F.when(reason.rlike(form), F.regexp_extract(reason, form, 1)).otherwise("other"), F.when(reason.rlike(form), F.regexp_extract(reason, form, 2)).otherwise(F.coalesce(reason, F.lit("")))


def to_iso(c: Column) -> Column:
    """A stored time as ISO 8601 with milliseconds in UTC; null for what is no time."""
    return F.date_format(c.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_locations(c: Column) -> Column:
    """Stored places as an array of (raw, city, country): a JSON array of objects or strings; blank ones, and what is neither,
    go. Broken JSON and null have none."""
    some = F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    kind = lambda v: F.schema_of_variant(v)
    get = lambda v, name: F.when(kind(v).startswith("OBJECT"), F.try_variant_get(v, f"$.{name}", "string"))
    one = lambda v: F.struct(blank(F.coalesce(get(v, "raw"), F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")))).alias("raw"), blank(get(v, "city")).alias("city"), blank(get(v, "country")).alias("country"))
    return F.filter(F.transform(some, one), lambda x: x["raw"].isNotNull())


def word_pattern(text: str) -> str:
    """Pattern of a whole word or phrase, where + and # belong to words."""
    import re

    return rf"(^|[^\p{{L}}\p{{N}}+#]){re.escape(text)}($|[^\p{{L}}\p{{N}}+#])"


#: What a line of a list begins with, how long a heading may be, and how many blocks a description keeps.
BULLET, MOST_HEADING, MOST_BLOCKS = r"^\s*(?:[-*•·])\s+", 70, 400


def blocks(text: Column, most: int | None = MOST_BLOCKS) -> Column:
    """The blocks of a description, as array of struct(kind, lines): parts between blank lines. A part whose lines all begin with a
    bullet is a ``list`` of its items; a single short line that ends in no punctuation is a ``heading``, without its colon; all
    else is a ``paragraph`` with its lines. At most ``most`` blocks (None: all). Null and blank texts have none."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n{2,}")
    lined = F.filter(F.transform(parts, lambda p: F.filter(F.split(p, "\n"), lambda x: trimmed(x) != "")), lambda x: F.size(x) > 0)

    def block(lines: Column) -> Column:
        only = trimmed(F.get(lines, 0))
        made = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("lines"))
        heading = (F.size(lines) == 1) & (F.length(only) <= MOST_HEADING) & ~only.rlike("[.!?,;]$")
        return (
            F.when(F.forall(lines, lambda x: x.rlike(BULLET)), made("list", F.transform(lines, lambda x: trimmed(F.regexp_replace(x, BULLET, "")))))
            .when(heading, made("heading", F.array(F.regexp_replace(only, ":$", "")))).otherwise(made("paragraph", F.transform(lines, trimmed)))
        )

    found = F.transform(lined, block)
    return found if most is None else F.slice(found, 1, most)
