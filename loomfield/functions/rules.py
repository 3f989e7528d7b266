"""Fields that a posting's wording states: pay, experience, work mode, deadline, visa, languages, skills. All of them are
array expressions over the matches of a pattern; a field with conflicting statements is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import dates, eligibility, flags, work_modes
from loomfield.functions import experience as ex
from loomfield.functions import languages as lg
from loomfield.functions.held import DIGITS, OPEN, SIGNS, has, held, known, within
from loomfield.functions.matches import around, at_words, let, ungrouped
from loomfield.functions.text import says

#: Pay wording.
CURRENCY = r"₹|\bRs\.?|\bINR\b|\bUSD\b|US\$|S\$|A\$|CA?\$|\$|€|\bEUR\b|£|\bGBP\b|\bAUD\b|\bCAD\b|\bSGD\b|\bAED\b"
AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
MAGNITUDE = r"\b(?:crores?|cr|lakhs?|lacs?|lpa)\b|[kK]\b"
PERIOD = r"/\s*(?:hour|hr|month|mo|year|yr)|per\s+(?:hour|day|month|year|annum)|p\.?\s*a\.?(?!\w)|hourly|daily|monthly|yearly|annual(?:ly)?|a\s+(?:month|year|hour|day)"
PAY = (
    rf"(?i)(\b(?:up\s*to|maximum|from|starting\s+(?:at|from)|minimum|between|ctc|stipend)\b)?[\s:]{{0,4}}({CURRENCY})?[\s:]{{0,4}}({AMOUNT})\s*({MAGNITUDE})?"
    rf"(?:\s*(–|—|-|to|and)\s*({CURRENCY})?\s*({AMOUNT})\s*({MAGNITUDE})?)?(\s*\+)?(?:\s*({PERIOD}))?"
)
#: Where a figure with its surroundings can begin: a cheap test in front of the patterns of pay.
_SIGN = r"[₹$€£]|[UuSsAaCc][SsAa]?\$|(?<![A-Za-z])(?i:rs|inr|usd|eur|gbp|aud|cad|sgd|aed)"
PAY_START = rf"(?=[0-9]|{_SIGN}|[\s:]{{1,8}}(?:[0-9]|{_SIGN})|(?<![A-Za-z])(?i:up|max|from|star|mini|betw|ctc|stip))"
PERIOD_BEFORE = r"(?i)\b(hourly|monthly|daily|yearly|annual|annually)\b(?!.*\b(?:hourly|monthly|daily|yearly|annual|annually)\b)"
FUNDING_AFTER = r"(?i)^\s{0,2}(?:m\b|b\b|mn\b|bn\b|million|billion)"
FUNDING = r"(?i)raised|funding|valuation|revenue|series\s+[a-z]\b|\bfunded"
PAY_WORDS = r"(?i)salary|compensation|\bpay\b|\bctc\b|\bbase\b|per\s+year|\blpa\b|annual"
MULTIPLES = {"k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lpa": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7}
CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "$": "USD", "usd": "USD", "us$": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "s$": "SGD", "sgd": "SGD", "a$": "AUD", "aud": "AUD", "c$": "CAD", "ca$": "CAD", "cad": "CAD", "aed": "AED"}
YEARLY = {"hour": 2080, "day": 260, "month": 12, "year": 1}

#: Wording of visas and joining.
VISA_NO = r"(?i)\b(?:no|not|unable\s+to|cannot|can't|won't|does\s+not)\b[^.\n]{0,40}\bsponsor\w*|\bwithout\s+(?:visa\s+)?sponsorship\b"
VISA_YES = r"(?i)\bvisa\s+sponsorship\b|\bsponsor\w*\s+(?:a\s+)?(?:work\s+)?visas?\b"
NOTICE = r"(?i)\bnotice\s+period[^.\n0-9]{0,25}(\d{1,3})\s*(day|week|month)s?\b"
IMMEDIATE = r"(?i)\b(?:immediate\s+join\w*|join\s+immediately)\b"

#: Words of which a text must hold one (``held``).
NAMED_PAY = SIGNS + known("rs inr usd eur gbp aud cad sgd aed crore crores cr lakh lakhs lac lacs lpa")
NAMED_JOINING = known("notice immediate immediately")


def scanned(text: Column) -> Column:
    """The whole text. Patterns take runs of white space whole where several could share one, so that they stay linear."""
    return F.coalesce(text, F.lit(""))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(key))


def agreed(values: Column) -> Column:
    """The one value that all statements agree on, else null."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, 0))


def _period(said: Column) -> Column:
    return F.when(said.rlike("hour|hr"), "hour").when(said.rlike("day|daily"), "day").when(said.rlike("mo"), "month").when(said != "", "year")


def pay(text: Column, words: Column | None = None) -> Column:
    """struct(low, high, currency, period) of disclosed pay. A currency or an Indian magnitude must stand at the figure; a magnitude
    on one side of a range holds for both, and "and" makes a range only behind "between". The period stands behind the figure,
    in LPA, or as the last such word in the 40 characters in front; without one, less than 10 000 is not judged. Funding is
    no pay. Of several different figures one counts only if all those near a word for pay agree on it.
    ``words``: what the text holds, if that is known (``held``)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda c: blank(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")

    # Each step reads the one before by name, so no expression stands in the plan more than once.
    def read(m: Column) -> Column:
        before = F.right(m["before"], F.lit(40))
        return F.struct(
            F.lower(F.regexp_replace(m["g1"], r"\s+", "")).alias("lead"), F.lower(m["g5"]).alias("joined"), F.lower(blank(m["g4"])).alias("m1"), F.lower(blank(m["g8"])).alias("m2"),
            number(m["g3"]).alias("n1"), number(m["g7"]).alias("n2"), F.lower(F.coalesce(blank(m["g2"]), blank(m["g6"]))).alias("sign"), (F.trim(m["g9"]) == "+").alias("plus"), F.lower(m["g10"]).alias("behind"),
            F.lower(F.regexp_extract(F.regexp_replace(before, "\n", " "), PERIOD_BEFORE, 1)).alias("in_front"), F.concat(F.right(before, F.lit(30)), m["said"]).rlike(PAY_WORDS).alias("labelled"),
            (m["after"].rlike(FUNDING_AFTER) | F.concat(before, m["said"], m["after"]).rlike(FUNDING)).alias("funding"),
        )

    def weigh(x: Column) -> Column:
        shared = F.coalesce(x["m1"], x["m2"])
        times = lambda own: F.coalesce(_lookup(MULTIPLES, F.coalesce(own, shared)), F.lit(1.0))
        ranged = (x["joined"] != "and") | (x["lead"] == "between")
        return F.struct(
            (x["n1"] * times(x["m1"])).alias("one"), F.when(ranged, x["n2"] * times(x["m2"])).alias("two"), F.coalesce(_lookup(CURRENCIES, x["sign"]), F.when(shared != "k", "INR")).alias("currency"),
            F.coalesce(_period(x["behind"]), F.when(shared == "lpa", "year"), _period(x["in_front"])).alias("stated"), x["lead"].isin("upto", "maximum").alias("most"),
            (x["lead"].isin("from", "startingat", "startingfrom", "minimum") | x["plus"]).alias("least"), x["labelled"].alias("labelled"), x["funding"].alias("funding"),
        )

    def bounds(x: Column) -> Column:
        low = F.when(x["two"].isNull() & x["most"], None).otherwise(F.least(x["one"], F.coalesce(x["two"], x["one"])))
        high = F.when(x["two"].isNotNull(), F.greatest(x["one"], x["two"])).when(~x["least"], x["one"])
        value = F.struct(low.alias("low"), high.alias("high"), x["currency"].alias("currency"), F.coalesce(x["stated"], F.lit("year")).alias("period"))
        return F.struct(value.alias("value"), F.coalesce(x["two"], x["one"]).alias("top"), x["stated"].isNotNull().alias("stated"), x["labelled"].alias("labelled"), x["funding"].alias("funding"))

    def good(x: Column) -> Column:
        floor = F.when(x["value"]["currency"] == "INR", 10_000).otherwise(1000)
        return x["value"]["currency"].isNotNull() & (x["stated"] | (x["top"] >= 10_000)) & ((x["value"]["period"] != "year") | (x["top"] >= floor)) & ~x["funding"]

    def judged(found: Column) -> Column:
        values = lambda x: F.array_distinct(F.transform(x, lambda v: v["value"]))
        several = F.struct(values(found).alias("all"), values(F.filter(found, lambda v: v["labelled"])).alias("labelled"))
        pick = lambda v: F.when(F.size(v["all"]) == 1, F.get(v["all"], 0)).when(F.size(v["labelled"]) == 1, F.get(v["labelled"], 0))
        return let(several, pick)

    own = scanned(text)
    anchored = own.rlike(rf"(?=[0-9]|{_SIGN})(?:(?i)(?:{CURRENCY})[\s:]{{0,4}}[0-9]|[0-9]\s*(?:{MAGNITUDE}))")
    marked = says(text, "₹", "$", "€", "£", "rs", "inr", "usd", "eur", "gbp", "aud", "cad", "sgd", "aed", "crore", "cr", "lakh", "lac", "lpa") & own.rlike("[0-9]")
    found = F.filter(F.transform(F.transform(F.transform(around(own, PAY, 40, 40, 10, ungrouped(PAY), PAY_START), read), weigh), bounds), good)
    return within(words, text, lambda w: F.when(has(w, NAMED_PAY) & has(w, DIGITS) & marked & anchored, let(found, judged)))


def pay_in_rupees(rows: DataFrame, rates: DataFrame, column: str = "pay") -> DataFrame:
    """``rows`` with yearly rupee bounds, from a table (currency, inr); currencies without a rate stay unknown."""
    p = F.col(column)
    per_year = _lookup(YEARLY, p["period"])
    own = rows.withColumn("_currency", p["currency"]).join(rates.select(F.col("currency").alias("_currency"), "inr"), "_currency", "left")
    rate = F.when(p["currency"] == "INR", 1.0).otherwise(F.col("inr"))
    return own.withColumn("inr_low", p["low"] * rate * per_year).withColumn("inr_high", p["high"] * rate * per_year).drop("_currency", "inr")


def experience(text: Column, title: Column | None = None, words: Column | None = None) -> Column:
    """struct(least, most) years; statements over 40 years don't count, freshers start at 0, conflicts are unknown."""
    return ex.experience(text, title, words)


def work_mode(text: Column, words: Column | None = None) -> Column:
    """remote, hybrid or onsite, if the text states one for its job."""
    return work_modes.work_mode(text, words)


def visa(text: Column, words: Column | None = None) -> Column:
    """no before yes; both, once refusals are taken out, is unknown."""
    own = scanned(text)
    both = F.struct(own.rlike(at_words(VISA_NO)).alias("no"), F.regexp_replace(own, at_words(VISA_NO), " ").rlike(at_words(VISA_YES)).alias("yes"))
    judged = lambda x: F.when(x["no"] & x["yes"], None).when(x["no"], "no").when(x["yes"], "yes")
    return within(words, text, lambda w: F.when(has(w, OPEN) & says(text, "sponsor"), let(both, judged)))


def joining(text: Column, words: Column | None = None) -> Column:
    """struct(kind, days): immediate, or a notice period."""
    own = scanned(text)
    notice, immediate = at_words(NOTICE), at_words(IMMEDIATE)
    unit = F.regexp_extract(own, notice, 2)
    days = F.regexp_extract(own, notice, 1).try_cast("int") * F.when(F.lower(unit) == "week", 7).when(F.lower(unit) == "month", 30).otherwise(1)
    stated = F.when(own.rlike(notice), F.struct(F.lit("notice_days").alias("kind"), days.alias("days"))).when(own.rlike(immediate), F.struct(F.lit("immediate").alias("kind"), F.lit(0).alias("days")))
    return within(words, text, lambda w: F.when(has(w, NAMED_JOINING) & says(text, "notice", "join"), stated))


def languages(text: Column, words: Column | None = None) -> Column:
    """Languages that a posting requires; those named as a plus don't count."""
    return lg.languages(text, words)["required"]


def skills(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, skill, importance) of the dictionary's terms (term, skill) that a text names as whole words, up to four words
    long. Lines under a heading, or with a cue, for extras make a skill nice to have; must outranks nice. Words are
    exploded and joined, so the dictionary may be of any size."""
    nice_head = r"(?i)^\W*(?:nice[- ]to[- ]have|preferred|bonus|good[- ]to[- ]have|plus(?:es)?)\b"
    must_head = r"(?i)^\W*(?:requirements?|must[- ]have|required|qualifications?|what\s+you\s+need)\b"
    said = F.transform(F.split(scanned(F.col(text)), "\n"), lambda s, i: F.struct(i.alias("line"), s.alias("said"), F.when(s.rlike(nice_head), "nice").when(s.rlike(must_head), "must").alias("head")))
    lines = rows.select(key, said.alias("all")).withColumn("heads", F.filter("all", lambda x: x["head"].isNotNull())).select(key, "heads", F.inline("all"))
    section = F.element_at(F.filter("heads", lambda h: h["line"] <= F.col("line")), -1)["head"]
    lines = lines.withColumn("section", F.when(F.exists("heads", lambda h: h["line"] <= F.col("line")), section))
    near = F.col("said").rlike(r"(?i)\b(?:nice\s+to\s+have|preferred|a\s+plus|bonus)\b")
    words = F.filter(F.split(F.lower("said"), r"[^\p{L}\p{N}+#.]+"), lambda w: w != "")
    cleaned = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    said = lines.withColumn("w", cleaned).select(key, F.when(near, "nice").otherwise(F.coalesce("section", F.lit("must"))).alias("importance"), F.explode(F.array_distinct(spans)).alias("term"))
    return said.join(dictionary.select(F.lower("term").alias("term"), "skill"), "term").groupBy(key, "skill").agg(F.min("importance").alias("importance"))


def parts_of(title: Column, text: Column, seen: Column | None = None, country: Column | None = None, words: Column | None = None) -> dict[str, Column]:
    """What each rule finds, by rule. ``seen`` and ``country``: the posting's time and place, for dates. ``words``: what title and
    text hold, if that is known (``held``)."""
    return {
        "pay": pay(text, words), "years": experience(text, title, words), "joining": joining(text, words), "mode": work_mode(F.concat_ws("\n", title, text), words),
        "deadline": dates.deadline(text, seen, country, words), "visa": visa(text, words), "languages": languages(text, words), "flags": F.transform(flags.hard_flags(title, text, words=words), lambda x: x["flag"]),
        "level": ex.level(title, text, words), "eligibility": eligibility.eligibility(text, words), "permits": eligibility.permits(text, words),
    }


def fields_of(found: dict[str, Column]) -> Column:
    """All fields of a posting as one struct, from ``parts_of``."""
    p, e, j, c = found["pay"], found["years"], found["joining"], found["eligibility"]
    return F.struct(
        p["low"].alias("pay_low"), p["high"].alias("pay_high"), p["currency"].alias("pay_currency"), p["period"].alias("pay_period"), e["least"].alias("years_least"), e["most"].alias("years_most"),
        found["level"].alias("seniority"), found["mode"].alias("work_mode"), found["deadline"].alias("deadline"), found["visa"].alias("visa"),
        j["kind"].alias("joining"), j["days"].alias("joining_days"), F.array_join(found["languages"], ",").alias("languages"), F.array_join(found["flags"], ",").alias("flags"),
        c["countries"].alias("countries"), c["scope"].alias("scope"), F.when(F.size(found["permits"]) > 0, found["permits"]).alias("permits"),
    )


def with_fields(rows: DataFrame, title: Column, text: Column, name: str = "_rules", seen: Column | None = None, country: Column | None = None) -> DataFrame:
    """``rows`` with all fields as the struct ``name``. The words that title and text hold, and what a rule finds, are each worked
    out in a projection of their own, so once per row, however many rules and fields come from them."""
    found = parts_of(title, text, seen, country, F.col("_held"))
    own = rows.withColumn("_held", held(F.concat_ws("\n", title, text))).withColumns({f"_found_{k}": c for k, c in found.items()})
    return own.withColumn(name, fields_of({k: F.col(f"_found_{k}") for k in found})).drop("_held", *[f"_found_{k}" for k in found])


def fill(known: Column, provenance: Column, found: Column) -> tuple[Column, Column, Column]:
    """(value, provenance, conflict) of a field: a rule only fills what is unknown, and differing values are a conflict."""
    return F.coalesce(known, found), F.when(known.isNotNull(), provenance).when(found.isNotNull(), "rule"), known.isNotNull() & found.isNotNull() & (known != found)
