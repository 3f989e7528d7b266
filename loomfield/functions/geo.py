"""Countries and regions as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of the regions that postings name.
EU = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE".split()
EMEA_MORE = (
    "AL AD BA BY FO GI GG IM IS JE LI MC MD ME MK NO RS SM CH UA GB VA XK AE BH EG IL IQ IR JO KW LB OM PS QA SA SY TR YE "
    "DZ AO BJ BW BF BI CM CV CF TD KM CG CD DJ GQ ER SZ ET GA GM GH GN GW CI KE LS LR LY MG MW ML MR MU MA MZ NA NE NG RW "
    "ST SN SC SL SO ZA SS SD TZ TG TN UG ZM ZW"
).split()
APAC = (
    "AU BN KH CN CK FJ PF HK IN ID JP KI KP KR LA MO MY MV MH FM MN MM NR NP NZ NU NF MP PK PW PG PH PN WS SG SB LK TW TH "
    "TL TO TV VU VN WF"
).split()
LATAM = "AR BO BR CL CO CR CU DO EC SV GT HT HN MX NI PA PY PE PR UY VE".split()
REGIONS = {
    "eu": EU, "european union": EU, "emea": EU + EMEA_MORE, "apac": APAC, "asia-pacific": APAC, "asia pacific": APAC,
    "latam": LATAM, "latin america": LATAM, "north america": ["US", "CA"],
}

#: Names and aliases of common countries; a larger table is joined with ``resolve``.
COUNTRIES = {
    "india": "IN", "bharat": "IN", "united states": "US", "usa": "US", "u.s.": "US", "united kingdom": "GB", "uk": "GB", "england": "GB",
    "germany": "DE", "deutschland": "DE", "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "belgium": "BE", "ireland": "IE",
    "portugal": "PT", "poland": "PL", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "switzerland": "CH", "austria": "AT",
    "canada": "CA", "mexico": "MX", "brazil": "BR", "argentina": "AR", "colombia": "CO", "chile": "CL", "australia": "AU", "new zealand": "NZ",
    "singapore": "SG", "japan": "JP", "china": "CN", "hong kong": "HK", "south korea": "KR", "indonesia": "ID", "malaysia": "MY", "philippines": "PH",
    "thailand": "TH", "vietnam": "VN", "pakistan": "PK", "bangladesh": "BD", "sri lanka": "LK", "nepal": "NP", "united arab emirates": "AE", "uae": "AE",
    "saudi arabia": "SA", "qatar": "QA", "israel": "IL", "turkey": "TR", "egypt": "EG", "nigeria": "NG", "kenya": "KE", "south africa": "ZA",
}


def _mapping(table: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for k, v in table.items() for x in (k, F.array(*[F.lit(c) for c in v]) if isinstance(v, list) else v)])


def country_code(c: Column) -> Column:
    """Code of a country's name or alias in any case, or of a code in upper case; else null."""
    key = F.trim(c)
    codes = sorted(set(COUNTRIES.values()))
    return F.when(key.rlike("^[A-Z]{2}$") & key.isin(codes), key).otherwise(F.try_element_at(_mapping(COUNTRIES), F.lower(key)))


def resolve(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``country`` from a dimension table (name, code); names match in any case."""
    names = table.select(F.lower("name").alias("_name"), F.col("code").alias("country"))
    return rows.join(names, F.lower(F.trim(column)) == F.col("_name"), "left").drop("_name")


def expand_regions(c: Column) -> Column:
    """Distinct countries of an array of regions, country names and codes."""
    regions = _mapping(REGIONS)
    one = lambda x: F.coalesce(F.try_element_at(regions, F.lower(F.trim(x))), F.array_compact(F.array(country_code(x))))
    return F.array_distinct(F.flatten(F.transform(c, one)))


def combine_scopes(options: Column) -> Column:
    """Scope of several options: worldwide wins over regions, regions over countries; unknown without any."""
    return F.when(F.array_contains(options, "worldwide"), "worldwide").when(F.array_contains(options, "regions"), "regions").when(F.array_contains(options, "countries"), "countries")
