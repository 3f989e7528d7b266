"""Years of experience that a posting asks for, and the level that its title names. Texts are read whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.held import has, known, within
from loomfield.functions.matches import WORD, around, let, ungrouped
from loomfield.functions.text import says

#: Fixed values (white space is taken whole, so that long runs of it stay linear): statements of years and months; no one is asked for more than 40 years, and months end at 36.
_NUMBER, _UNIT, _TO = r"[0-9]{1,3}(?:\.[0-9]+)?", r"(?:years?|yrs?|yoe)", r"(?:–|—|-|to)"
RANGE = rf"(?i:(?:\b(?:minimum|min|at\s+least|up\s+to|maximum|max)\b[\s:]{{0,3}})?({_NUMBER})\s*+{_TO}\s*+({_NUMBER})\s*+{_UNIT}\b)"
PLUS = rf"(?i:({_NUMBER})\s*+\+\s*+{_UNIT}\b)"
MINIMUM = rf"(?i:\b(?:minimum|min|at\s+least)\b[\s:]+({_NUMBER})\s*+{_UNIT}\b)"
UP_TO = rf"(?i:\b(?:up\s+to|maximum|max)\b[\s:]+({_NUMBER})\s*+{_UNIT}\b)"
LESS_THAN_YEAR = r"(?i:\b(?:less\s+than|under|below)\s+(a|1|one)\s+year\b)"
MONTHS = rf"(?i:([0-9]{{1,2}})\s*+{_TO}\s*+([0-9]{{1,2}})\s*+months?\b)"
SINGLE = rf"(?i:({_NUMBER})\s*+{_UNIT}\b(\s*+\+)?)"
MONTH = r"(?i:([0-9]{1,2})\s*+\+?\s*+months?\b)"
MONTH_BEHIND = r"(?i)^[^.]{0,30}\b(?:experience|exp)\b"
MOST_YEARS, MOST_MONTHS = 40, 36

#: Wording around a bare number of years that makes it a requirement, or none.
ASKS = r"(?i)\b(?:experience|experiences|exp|yoe|required|requirement|requirements|minimum|working|fresher|freshers|preferred|plus)\b|\bat\s+least\b|\bmin\b"
OLD, FOR, OF, IN_SKILL = r"(?i)^\s*old\b", r"(?i)\bfor\b", r"(?i)\bof\b[\s:]{0,5}$", r"(?i)years?\s+(?:in|of)\s+[A-Z][A-Za-z+#.]+"

#: Beginners in descriptions, with wording that takes it back, and in titles.
FRESHER_TEXT = (
    r"(?i:\bfreshers?\b|\bentry[\s-]*level\b|\b(?:batch|class)\s+of\s+20[0-9]{2}\b|\b20[0-9]{2}\s+(?:batch|pass[\s-]?outs?)\b|\bnew\s+grad(?:uate)?s?\s+20[0-9]{2}\b"
    r"|\b(?:seeking|looking\s+for|hiring|ideal\s+for|suited\s+for|open\s+to|welcomes?)\s+(?:an?\s+)?(?:[a-z-]+\s+){0,2}?(?:recent\s+graduates?|new\s+grad(?:uate)?s?)\b"
    r"|\bno\s+(?:prior\s+|previous\s+)?(?:work\s+)?experience\s+(?:is\s+)?(?:required|needed|necessary)\b)"
)
NEGATED = r"(?i)(?:\bnot\b|\bno\b|\bnever\b|\bnor\b|\bexcept\b|\bexcluding\b|\bwithout\b|\bunless\b|n't\b)[^.\n]{0,60}$"
TO_SENIOR = r"(?i)^\s*(?:\w+\s+){0,2}(?:to|and|through)\s+(?:senior|experienced|staff|lead|principal)\b"
FRESHER_HEAD = (
    r"(?i)\bfreshers?\b|\bentry[\s-]*level\b|\bnew\s+grad(?:uate)?s?(?:\s+20[0-9]{2})?|\brecent\s+graduates?\b|\bno\s+(?:prior\s+|previous\s+)?experience\b"
    r"|\b(?:batch|class)\s+of\s+20[0-9]{2}\b|\b20[0-9]{2}\s+(?:batch|graduates?|pass[\s-]?outs?)\b"
)
FRESHER_TITLE = (
    r"(?i)\btrainee\b|\bapprentice(?:ship)?\b|\bearly[\s-]*career\b|\bcampus(?:\s+(?:hire|recruit\w*|graduate|drive))?\b"
    r"|\bgraduate\s+(?:engineer|programme|program|trainee|hire|scheme|role|software|developer|analyst)\b|\buniversity\s+graduate\b|\bfresh\s+graduate\b|\bgraduate\b(?=\s*[-,(]|\s*$)"
)
#: Levels in titles, first match wins; "grade" is a corporate grade that names no level.
_ROLE = r"(?:sde|swe|sdet|software\s+(?:development\s+)?(?:engineer|developer)|engineer|developer|analyst|associate|specialist|designer|consultant|scientist|programmer)"
LEVELS = (
    ("intern", r"(?i)\bintern(?:s|ship)?\b"), ("director", r"(?i)\b(?:s\.?v\.?p\.?|e\.?v\.?p\.?|vp|v\.?p\.?|director)\b|\bhead\s+of\b"), ("principal", r"(?i)\bprincipal\b"), ("staff", r"(?i)\bstaff\b"), ("lead", r"(?i)\blead\b"),
    ("grade", r"(?i)\b(?:senior|sr\.?)\s+(?:(?:process|customer\s+(?:support|service|care|success)|sales|operations|ops|support|hr|accounts?|admin\w*|tele\w*|voice|non-voice|business\s+development|content|marketing)\s+)?(?:associate|executive)s?\b"),
    ("senior", r"(?i)\bsenior\b|\bsr\.?(?!\w)"), ("lead", r"(?i)\b(?:engineering|software|data|product\s+design|design)\s+manager\b"),
    ("senior", rf"(?i)\b{_ROLE}[\s,-]*(?:iii|iv|v|3|4|5|l3|l4|l5|level\s*[3-5])(?![A-Za-z0-9+#])"), ("mid", rf"(?i)\b{_ROLE}[\s,-]*(?:ii|2|l2|level\s*2)(?![A-Za-z0-9+#])"),
    ("entry", r"(?i)\bjunior\b|\bjr\.?(?!\w)|\bassociate\b"), ("entry", FRESHER_TITLE), ("entry", rf"(?i)\b{_ROLE}[\s,-]*(?:i|1|l1|level\s*1)(?![A-Za-z0-9+#])"),
)
ABOVE_ENTRY = ("senior", "lead", "staff", "principal", "director", "mid")

#: Statements that look beyond themselves come last; at one place of a text the first that fits is read.
STATED_START = r"(?=[0-9]|(?<![A-Za-z])(?i:min|at\s|up\s|max|less|under|below))"
SHAPES = {"range": RANGE, "plus": PLUS, "minimum": MINIMUM, "up_to": UP_TO, "months": MONTHS, "less": LESS_THAN_YEAR, "single": SINGLE, "month": MONTH}

#: Words of which a text must hold one (``held``).
NAMED, NAMED_FRESHER = known("year years yr yrs yoe month months"), known("fresher freshers entry entrylevel batch class pass passout passouts grad grads graduate graduates experience")


def title_level(title: Column) -> Column:
    out = None
    for name, pattern in LEVELS:
        value = F.lit(None if name == "grade" else name).cast("string")
        out = F.when(title.rlike(pattern), value) if out is None else out.when(title.rlike(pattern), value)
    return out


def _fresher(text: Column, w: Column) -> Column:
    """A statement for beginners that is not taken back and is no range up to seniors."""
    return F.when(has(w, NAMED_FRESHER) & says(text, "fresher", "entry", "20", "grad", "experience"), F.exists(around(text, FRESHER_TEXT, 80, 40, start=WORD), lambda m: ~m["before"].rlike(NEGATED) & ~m["after"].rlike(TO_SENIOR)))


def level(title: Column, text: Column, words: Column | None = None) -> Column:
    """The level that the title names; entry where only wording for beginners says so."""
    return F.coalesce(title_level(title), F.when(within(words, text, lambda w: F.coalesce(_fresher(text, w), F.lit(False))) | F.coalesce(title.rlike(FRESHER_HEAD), F.lit(False)), "entry"))


def experience(text: Column, title: Column | None = None, words: Column | None = None) -> Column:
    """struct(least, most) years. Bare years need a word that asks for them nearby; differing statements are unknown; beginners
    start at 0 unless the title is above entry, which agrees with a stated range from 0.
    ``words``: what the text holds, if that is known (``held``)."""
    head = F.coalesce(title, F.lit("")) if title is not None else F.lit("")

    def read(m: Column) -> Column:
        part = lambda shape, i: F.regexp_extract(m["said"], f"^{SHAPES[shape]}$", i)
        is_a = lambda shape: m["said"].rlike(f"^{ungrouped(SHAPES[shape])}$")

        def years(shape: str, i: int) -> Column:
            n = part(shape, i).try_cast("double")
            return F.when(n <= MOST_YEARS, n)

        pair = lambda least, most: F.struct(least.cast("double").alias("least"), most.cast("double").alias("most"))
        none, near = F.lit(None), F.concat(m["before"], m["said"], m["after"])
        asked = ~m["after"].rlike(OLD) & F.when(near.rlike(ASKS), True).when(F.right(m["before"], F.lit(25)).rlike(FOR), False).otherwise(m["before"].rlike(OF) | F.left(F.concat(m["said"], m["after"]), F.lit(60)).rlike(IN_SKILL))
        a, b = years("range", 1), years("range", 2)
        ma, mb, one = part("months", 1).try_cast("int"), part("months", 2).try_cast("int"), part("month", 1).try_cast("int")
        in_years = lambda n: F.round(n / 12, 2)
        single = years("single", 1)
        return (
            F.when(is_a("range"), F.when(a.isNotNull() & b.isNotNull(), pair(F.least(a, b), F.greatest(a, b))))
            .when(is_a("plus"), F.when(years("plus", 1).isNotNull(), pair(years("plus", 1), none))).when(is_a("minimum"), F.when(years("minimum", 1).isNotNull(), pair(years("minimum", 1), none)))
            .when(is_a("up_to"), F.when(years("up_to", 1).isNotNull(), pair(none, years("up_to", 1))))
            .when(is_a("months"), F.when(F.greatest(ma, mb) <= MOST_MONTHS, pair(in_years(F.least(ma, mb)), in_years(F.greatest(ma, mb)))))
            .when(is_a("less"), F.when((part("less", 1) == "1") & asked, pair(F.lit(1), none)).otherwise(pair(F.lit(0), F.lit(1))))
            .when(is_a("single"), F.when((part("single", 2) == "") & single.isNotNull() & asked, pair(single, none)))
            .when((one > 0) & (one <= MOST_MONTHS) & m["after"].rlike(MONTH_BEHIND), pair(in_years(one), none))
        )

    every = ungrouped("|".join(SHAPES.values()))
    stated = F.array_compact(F.transform(around(text, f"(?:{every})", 60, 60, start=STATED_START), read))
    nothing = F.expr("cast(array() as array<struct<least: double, most: double>>)")
    marked = lambda w: F.when(has(w, NAMED) & says(text, "year", "yr", "yoe", "month"), stated).otherwise(nothing)
    beginner = lambda w: (F.coalesce(_fresher(text, w), F.lit(False)) | head.rlike(FRESHER_HEAD) | head.rlike(FRESHER_TITLE)) & ~F.coalesce(title_level(head).isin(*ABOVE_ENTRY), F.lit(False))
    start = F.array(F.struct(F.lit(0.0).alias("least"), F.lit(None).cast("double").alias("most")))

    def every_one(found: Column, w: Column) -> Column:
        agrees = F.exists(found, lambda x: (x["least"] == 0) & x["most"].isNotNull())
        return F.array_distinct(F.when(agrees, F.filter(found, lambda x: ~((x["least"] == 0) & x["most"].isNull()))).when(beginner(w), F.concat(found, start)).otherwise(found))

    return let(within(words, text, lambda w: let(marked(w), lambda found: every_one(found, w))), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
