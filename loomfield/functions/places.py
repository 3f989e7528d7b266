"""Places of postings: location texts read against a gazetteer, with mode, countries and scope, and cities with their region.

A gazetteer is a table (name, kind, code): cities and countries with their country's code, states with "US", regions
with the codes of their members. Names are found by longest match as whole words (``automaton.Matcher``). The table's own rows are
few; a larger one, of every city, is the caller's parameter. It goes to the tasks, so its size is checked first.

Precedence: region words before countries ("Southeast Asia" is no Asia), state codes before country codes behind a city ("San
Francisco, CA"), and what is both a state and a country (Georgia) is neither. Of several options the modes must agree; what
follows an exclusion is never counted. Null and blank texts are unknown, and so is whatever a text doesn't say.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import geo
from loomfield.functions.automaton import Matcher, collected, single_blanks

#: Wording of modes, of everywhere and of exclusions in location texts, and what stands between options.
REMOTE = re.compile(r"\b(?:remote(?:ly)?|work[\s-]*from[\s-]*home|wfh|telecommut\w*|distributed|virtual(?:ly)?)\b", re.I)
ANYWHERE = re.compile(r"\b(?:anywhere(?:\s+in\s+(?:the\s+)?world)?|worldwide|world[\s-]*wide|global(?:ly)?|any\s+location)\b", re.I)
HYBRID = re.compile(r"\bhybrid\b", re.I)
ONSITE = re.compile(r"\b(?:on[\s-]*site|in[\s-]*office|office[\s-]*based|in[\s-]*person)\b", re.I)
EXCLUDE = re.compile(r"\b(?:excluding|exclude|except|outside(?:\s+of)?|not\s+(?:open|available)|ex[-\s]?)\b", re.I)
BETWEEN = re.compile(r"\s*(?:;|\||/|\bor\b|\band/or\b)\s*", re.I)
MOST_TEXT, MOST_OPTIONS = 300, 12

#: Cities of India, which texts name without their country, and other well-known cities by country.
INDIA_CITIES = ("bengaluru", "bangalore", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "noida", "hyderabad", "pune", "chennai", "kolkata", "ahmedabad")
CITIES = {
    "GB": "london, manchester, edinburgh", "IE": "dublin", "DE": "berlin, munich, hamburg", "FR": "paris", "NL": "amsterdam", "ES": "madrid, barcelona", "PT": "lisbon", "PL": "warsaw", "SE": "stockholm", "DK": "copenhagen", "CH": "zurich",
    "AT": "vienna", "CZ": "prague", "IL": "tel aviv", "AE": "dubai, abu dhabi", "CA": "toronto, vancouver, montreal", "AU": "sydney, melbourne", "NZ": "auckland", "JP": "tokyo", "KR": "seoul", "HK": "hong kong", "MY": "kuala lumpur",
    "ID": "jakarta", "PH": "manila", "TH": "bangkok", "VN": "ho chi minh city, ho chi minh, hanoi, da nang", "PK": "karachi, lahore", "BD": "dhaka", "LK": "colombo", "NP": "kathmandu", "KE": "nairobi", "NG": "lagos",
    "ZA": "cape town, johannesburg", "EG": "cairo", "BR": "sao paulo, são paulo", "AR": "buenos aires", "MX": "mexico city", "CO": "bogota, bogotá", "CL": "santiago", "PE": "lima",
    "US": "san francisco, new york city, nyc, seattle, austin, boston, chicago, los angeles, denver, atlanta, miami, san jose, san diego, portland, washington dc, palo alto, mountain view, menlo park",
}
#: States of the US and their codes.
STATES = (
    "alabama al, alaska ak, arizona az, arkansas ar, california ca, colorado co, connecticut ct, delaware de, florida fl, georgia ga, hawaii hi, idaho id, illinois il, indiana in, iowa ia, kansas ks, kentucky ky, louisiana la, maine me, "
    "maryland md, massachusetts ma, michigan mi, minnesota mn, mississippi ms, missouri mo, montana mt, nebraska ne, nevada nv, new hampshire nh, new jersey nj, new mexico nm, new york ny, north carolina nc, north dakota nd, ohio oh, "
    "oklahoma ok, oregon or, pennsylvania pa, rhode island ri, south carolina sc, south dakota sd, tennessee tn, texas tx, utah ut, vermont vt, virginia va, washington wa, west virginia wv, wisconsin wi, wyoming wy, district of columbia dc"
)
#: Regions beyond those of ``geo.REGIONS``, by their members or by other regions.
REGIONS = {
    "asia": "apac", "southeast asia": "SG MY ID TH VN PH MM KH LA BN TL", "south east asia": "southeast asia", "sea": "southeast asia", "south asia": "IN PK BD LK NP BT MV AF", "europe": "emea", "americas": "north america+latam",
    "mena": "AE SA QA KW BH OM JO LB IL IQ TR EG", "middle east": "mena", "anz": "AU NZ", "oceania": "anz", "nordics": "SE NO DK FI IS", "nordic": "nordics",
}
#: Other names of countries.
ALIASES = {
    "uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "usa": "US", "u.s.": "US", "u.s.a.": "US", "uae": "AE", "bharat": "IN", "deutschland": "DE", "czech republic": "CZ", "turkey": "TR",
    "turkiye": "TR", "korea": "KR", "russia": "RU", "hong kong": "HK", "macau": "MO", "myanmar": "MM", "burma": "MM", "ivory coast": "CI", "congo": "CG", "democratic republic of the congo": "CD", "vatican city": "VA",
}
#: Words that are no country by themselves, and headings of places in texts.
NO_COUNTRY = frozenset(("remote", "work", "from", "home", "city", "area", "time", "zone", "georgia"))
HEADING = re.compile(r"^[ \t#*_>]*(?:available\s+|office\s+|job\s+|work\s+|hiring\s+)?locations?[ \t*_]*(?:(?P<colon>:)[ \t*_]*(?P<inline>[^\n]*))?$", re.I | re.M)
SECTION_LINES, LINE = 8, 60

_UPPER = re.compile(r"(?<![A-Za-z])(US|USA|UK|UAE|IN)(?![A-Za-z])")
_UPPER_CODE = {"USA": "US", "UK": "GB", "UAE": "AE"}
_CITY_REGION = re.compile(r"(?:remote\s*[-–]\s*)?([A-Za-z][A-Za-z\s.\-']{1,50})\s*,\s*([A-Za-z]{2,}(?:\s+[A-Za-z]{2,}){0,2})|remote\s*[-–]\s*([A-Za-z]{2,}(?:\s+[A-Za-z]{2,}){0,2})", re.I)


def _members(region: str) -> list[str]:
    if region in geo.REGIONS:
        return list(geo.REGIONS[region])
    return [c for part in REGIONS[region].split("+") for c in (_members(part) if part in REGIONS or part in geo.REGIONS else part.split())]


def gazetteer(spark: SparkSession) -> DataFrame:
    """(name, kind, code): the fixed cities, states, regions and aliases, and the countries as Java's locale data name them."""
    locale = spark._jvm.java.util.Locale
    names = {locale("", c).getDisplayCountry(locale.ENGLISH).lower().replace("&", "and"): c for c in locale.getISOCountries()}
    rows = [(n, "country", c) for n, c in (names | ALIASES).items()]
    rows += [(c, "city", "IN") for c in INDIA_CITIES] + [(c, "city", code) for code, listed in CITIES.items() for c in listed.split(", ")]
    for state in STATES.split(", "):
        name, code = state.rsplit(" ", 1)
        rows += [(name, "state", "US"), (code, "state", "US")]
    rows += [(r, "region", " ".join(sorted(set(_members(r))))) for r in [*geo.REGIONS, *REGIONS]]
    return spark.createDataFrame(rows, "name string, kind string, code string")


class Reader:
    """Reads location texts. ``rows``: those of a gazetteer."""

    def __init__(self, rows: tuple[tuple[str, str, str], ...]):
        of = lambda kind: {n.lower(): c for n, k, c in rows if k == kind}
        self.countries, self.states, self.cities, self.regions = of("country"), of("state"), of("city"), {n: frozenset(c.split()) for n, c in of("region").items()}
        self.codes = set(self.countries.values())
        self.indian = Matcher(((n, "IN") for n in INDIA_CITIES), r"\w")
        self.region_words = Matcher(((n, n) for n in self.regions), "[A-Za-z]")
        self.city_words = Matcher(((n, c) for n, c in self.cities.items()), "[A-Za-z]")
        self.state_words = Matcher(((n, c) for n, c in self.states.items() if len(n) > 2 and n != "georgia"), "[A-Za-z]")
        self.country_words = Matcher(((n, c) for n, c in self.countries.items() if " " in n or (len(n) > 3 and n not in NO_COUNTRY)), "[A-Za-z.'-]")

    def country(self, name: str) -> str | None:
        """Code of a country's name in any case, or of a code in upper case."""
        name = name.strip()
        return name if len(name) == 2 and name.isupper() and name in self.codes else self.countries.get(name.lower())

    def inferred(self, city: str | None, region: str | None) -> str | None:
        """Country of "city, region": of an Indian city, a state, then a country."""
        if city and city.strip().lower() in INDIA_CITIES:
            return "IN"
        word = (region or "").strip()
        return self.states.get(word.lower()) or self.country(word) if word else None

    def locations(self, text: str | None) -> list[dict] | None:
        """The places that a text names as "City, Region", or else bare cities of India; an empty list for anywhere; None: unknown."""
        if not text or not text.strip():
            return None
        if re.search(r"\b(?:anywhere|worldwide|global\s+remote|work\s+from\s+anywhere)\b", text, re.I) and not _CITY_REGION.search(text):
            return []
        out, seen = [], set()
        place = lambda raw, city=None, region=None, country=None: {"raw": raw, "city": city, "region": region, "country": country}
        for segment in re.split(r"\s*[;|/]\s*|\s+or\s+", text):
            for m in _CITY_REGION.finditer(segment.strip()):
                raw, (city, region, behind) = m[0].strip(), m.groups()
                if raw.lower() in seen:
                    continue
                seen.add(raw.lower())
                if behind:
                    if code := self.country(behind):
                        out.append(place(raw, country=code))
                    continue
                code = self.inferred(city, region)
                if code or (region or "").strip().lower() in geo.REGIONS:  # else it is a title, such as "Engineer, Backend"
                    out.append(place(raw, city.strip() if city and len(city.split()) <= 3 else None, region.strip(), code))
        if not out:
            flat = single_blanks(text)
            for start, end, code in self.indian.find(flat):
                if flat[start:end].lower() not in seen:
                    seen.add(flat[start:end].lower())
                    out.append(place(flat[start:end], flat[start:end], None, code))
        return out or None

    def section(self, text: str | None) -> list[dict] | None:
        """The places that stand under a heading for locations, up to the next blank line, or behind its colon."""
        for m in HEADING.finditer(text or ""):
            inline, lines = (m["inline"] or "").strip(" \t*_"), []
            for line in [] if inline else text[m.end() :].split("\n")[: 2 * SECTION_LINES]:
                item = line.strip().lstrip("-•*·").strip()
                if (not item and lines) or len(item) > LINE or len(lines) >= SECTION_LINES:
                    break
                if item:
                    lines.append(item)
            found: list[dict] = []
            for candidate in [inline] if inline else lines:
                found += [x for x in self.locations(candidate) or [] if x["country"] and x not in found]
            if found:
                return found
        return None

    def _option(self, option: str) -> tuple[str | None, bool, bool, set[str], set[str], bool]:
        mode = "hybrid" if HYBRID.search(option) else "onsite" if ONSITE.search(option) else "remote" if REMOTE.search(option) else None
        hits = self.region_words.find(option)
        regions = set().union(*(self.regions[name] for _, _, name in hits))
        rest = option
        for start, end, _ in reversed(hits):
            rest = rest[:start] + " " + rest[end:]
        flat = single_blanks(rest)
        places = {_UPPER_CODE.get(c, c) for c in _UPPER.findall(flat)} | {c for words in (self.city_words, self.state_words, self.country_words) for _, _, c in words.find(flat)}
        places |= {x["country"] for x in self.locations(rest) or [] if x["country"]}
        if re.search("georgia", option, re.I) and not re.search("tbilisi|batumi|kutaisi", option, re.I):
            places.discard("GE")
        return mode, ANYWHERE.search(option) is not None, EXCLUDE.search(option) is not None, regions, places, bool(hits)

    def read(self, raw: str | None) -> tuple[str | None, str | None, tuple[str, ...]]:
        """(mode, scope, countries) of one location text."""
        text = re.sub("[–—]", "-", single_blanks(raw or ""))[:MOST_TEXT]
        modes, countries, of_regions, named, world, barred, before = [], set(), set(), False, False, False, None
        for option in [o for o in BETWEEN.split(text) if o.strip()][:MOST_OPTIONS]:
            mode, anywhere, excluded, regions, places, has_region = self._option(option)
            if mode is None and anywhere and not places and not regions:
                mode = "remote"
            if mode is None and before and (places or regions) and not anywhere:
                mode = before  # a bare list of places goes on: "Remote - US or Canada"
            modes.append(mode)
            before, barred = mode, barred or excluded
            if not excluded:
                world = world or (mode == "remote" and anywhere)
                countries |= places
                of_regions |= regions
                named = named or has_region
        mode = modes[0] if modes and None not in modes and len(set(modes)) == 1 else None
        if barred:
            return mode, None, ()
        if world and mode == "remote":
            return mode, "worldwide", ()
        if named and mode in ("remote", None):
            return mode, "regions", tuple(sorted(of_regions | countries))
        return mode, "countries" if countries else None, tuple(sorted(countries))

    def combined(self, raws: list[str | None]) -> tuple[str | None, str | None, tuple[str, ...]]:
        """Several location texts of one posting: modes must agree, the widest scope counts, countries are united. The bare name
        of a country beside other places is no option of its own."""
        named = [r for r in raws if r and self.country(r) is None]
        read = [x for x in map(self.read, named or [r for r in raws if r]) if x[0] or x[1]]
        modes, scopes = {m for m, _, _ in read}, {s for _, s, _ in read}
        scope = next((s for s in ("worldwide", "regions", "countries") if s in scopes), None)
        return modes.pop() if len(modes) == 1 else None, scope, tuple(sorted({c for _, _, cs in read for c in cs})) if scope in ("regions", "countries") else ()


#: Where a text says that the job can be filled, and what ends the place's name.
AVAILABLE = (
    r"(?i)\b(?:positions?|roles?|jobs?|opportunit(?:y|ies)|vacanc(?:y|ies))\b[^.\n]{0,60}?\b(?:are|is)\s+(?:only\s+)?(?:available|open)\s+(?:only\s+)?(?:in|to)\s+(?:the\s+)?([^.\n;]{2,70})"
    r"|\b(?:only\s+)?(?:open|available)\s+(?:only\s+)?to\s+(?:candidates|applicants|residents)\s+(?:who\s+are\s+)?(?:based|located|living|residing|resident)\s+in\s+(?:the\s+)?([^.\n;]{2,70})"
    r"|\b(?:candidates|applicants)\s+(?:must|need\s+to|have\s+to)\s+(?:be\s+)?(?:based|located|living|residing|resident)\s+in\s+(?:the\s+)?([^.\n;]{2,70})"
)
AFTER_PLACE = r"(?i)\b(?:but|while|however)\b.*|\band\s+(?:we|our|the|this|you|they|all)\b.*"


def availability(text: Column) -> Column:
    """The wordings of places where a text says its job can be filled (array of strings), each up to its next clause."""
    own = F.coalesce(text, F.lit(""))
    said = F.arrays_zip(*[F.regexp_extract_all(own, F.lit(AVAILABLE), F.lit(i)).alias(f"w{i}") for i in (1, 2, 3)])
    named = F.transform(said, lambda m: F.regexp_replace(F.concat(m["w1"], m["w2"], m["w3"]), AFTER_PLACE, ""))
    return F.when(own.rlike(AVAILABLE), F.transform(named, lambda w: F.regexp_replace(w, "^[ ,]+|[ ,]+$", ""))).otherwise(F.expr("cast(array() as array<string>)"))


PLACE = "struct<raw:string,city:string,region:string,country:string>"
READING = f"struct<mode:string,scope:string,countries:array<string>,places:array<{PLACE}>>"


@functools.lru_cache(4)
def _reader(rows: tuple) -> Reader:
    """One reader for each gazetteer of a task's process."""
    return Reader(rows)


def reader(table: DataFrame) -> Callable[[Column, Column, Column], Column]:
    """A function of (location texts, title, description) that gives struct(mode, scope, countries, places). Mode, scope and
    countries are those of the location texts; places are the cities, regions and countries of the texts, or without any those
    of a short title, or those under a heading of the description."""
    rows = collected(table.select("name", "kind", "code"))

    @F.pandas_udf(READING)
    def run(raws: pd.Series, titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own, out = _reader(rows), []
        for raw, title, text in zip(raws, titles, texts, strict=True):
            raw = [r for r in raw if r] if raw is not None else []
            mode, scope, countries = own.combined(raw)
            places = [x for r in raw for x in (own.locations(r) or [{"raw": r, "city": None, "region": None, "country": None}])]
            if not places:
                places = (own.locations(title) if title and len(title) <= 200 else None) or own.section(text)
            out.append((mode, scope, list(countries), places))
        return pd.DataFrame(out, columns=["mode", "scope", "countries", "places"])

    return run


RUNG = f"struct<mode:string,scope:string,countries:array<string>,places:array<{PLACE}>,title_mode:string,title_scope:string,title_countries:array<string>,available:array<string>>"


def rung_reader(table: DataFrame) -> Callable[[Column, Column, Column, Column, Column], Column]:
    """A function of (location texts, title segments, wordings of availability, title, description) that reads them all in one
    pass: ``reader``'s fields, those of the title's segments, and the countries of the first wording that names any."""
    rows = collected(table.select("name", "kind", "code"))

    @F.pandas_udf(RUNG)
    def run(raws: pd.Series, segments: pd.Series, wordings: pd.Series, titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        own, out = _reader(rows), []
        listed = lambda x: [v for v in x if v] if x is not None else []
        for raw, segment, wording, title, text in zip(raws, segments, wordings, titles, texts, strict=True):
            raw = listed(raw)
            mode, scope, countries = own.combined(raw)
            places = [x for r in raw for x in (own.locations(r) or [{"raw": r, "city": None, "region": None, "country": None}])]
            if not places:
                places = (own.locations(title) if title and len(title) <= 200 else None) or own.section(text)
            in_title = own.combined(listed(segment))
            available = next((c for w in listed(wording) if (c := own.read(w)[2])), None)
            out.append((mode, scope, list(countries), places, in_title[0], in_title[1], list(in_title[2]), list(available) if available else None))
        return pd.DataFrame(out, columns=["mode", "scope", "countries", "places", "title_mode", "title_scope", "title_countries", "available"])

    return run
