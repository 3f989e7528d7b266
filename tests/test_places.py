"""Location texts against the gazetteer: modes, scopes, countries, cities and headings."""

import pytest
from pyspark.sql import functions as F

from loomfield.functions import automaton, places

READ = [
    ("Remote - Kenya", "remote", "countries", ["KE"]), ("Remote, Peru or Chile", "remote", "countries", ["CL", "PE"]), ("Nepal (Remote)", "remote", "countries", ["NP"]), ("Remote | Remote - UK", "remote", "countries", ["GB"]), ("Remote - Atlanta, Georgia", "remote", "countries", ["US"]),
    ("Remote - Georgia", "remote", None, []), ("Global", "remote", "worldwide", []), ("Remote - any location", "remote", "worldwide", []), ("Remote, globally except Cuba", "remote", None, []),
    ("Remote", "remote", None, []), ("Hybrid - Lagos", "hybrid", "countries", ["NG"]), ("On-site - Dallas, TX", "onsite", "countries", ["US"]), ("Pune or Remote", None, "countries", ["IN"]), ("Remote - Nordics", "remote", "regions", ["DK", "FI", "IS", "NO", "SE"]),
    ("Remote - ANZ and Fiji", "remote", "regions", ["AU", "FJ", "NZ"]), ("Remote - Southeast Asia", "remote", "regions", sorted("SG MY ID TH VN PH MM KH LA BN TL".split())), ("New York City", None, "countries", ["US"]), ("United States", None, "countries", ["US"]),
    ("Guinea-Bissau", None, "countries", ["GW"]), ("Côte d’Ivoire", None, "countries", ["CI"]), ("in between", None, None, []), ("TBD", None, None, []), ("", None, None, []), (None, None, None, []), ("r" * 10_000, None, None, []),
]
LISTED = [
    ("Dallas, TX", [("Dallas", "TX", "US")]), ("Oslo, NO", [("Oslo", "NO", "NO")]), ("Lund, Sweden; Pune", [("Lund", "Sweden", "SE")]), ("Pune | Noida", [("Pune", None, "IN"), ("Noida", None, "IN")]), ("Remote - Peru", [(None, None, "PE")]), ("Lima, Peru or Quito, Ecuador", [("Lima", "Peru", "PE"), ("Quito", "Ecuador", "EC")]),
    ("Engineer, Backend", None), ("Berlin, EMEA", [("Berlin", "EMEA", None)]), ("A long sentence about nothing in Oslo, Norway", [(None, "Norway", "NO")]), ("Worldwide", []), ("", None), ("no place", None),
]
SECTIONS = [
    ("We have offices.\n\n## Job locations\n- Oslo, NO\n- Lund, Sweden\n\nLima, Peru", [("Oslo", "NO"), ("Lund", "SE")]), ("Location: Lima, Peru", [("Lima", "PE")]), ("**Locations**\n\n* Pune\n" + "x" * 70, [("Pune", "IN")]), ("Our locations are many: Lima, Peru", None), ("Location\n\nRemote", None), (None, None),
]


@pytest.fixture(scope="module")
def own(spark):
    return places.Reader(automaton.collected(places.gazetteer(spark)))


@pytest.mark.parametrize(("text", "mode", "scope", "countries"), READ)
def test_location_texts(own, text, mode, scope, countries):
    got = own.read(text)
    assert (got[0], got[1], list(got[2])) == (mode, scope, countries)


@pytest.mark.parametrize(("text", "want"), LISTED)
def test_cities_and_regions(own, text, want):
    got = own.locations(text)
    assert (got if not got else [(x["city"], x["region"], x["country"]) for x in got]) == want


@pytest.mark.parametrize(("text", "want"), SECTIONS)
def test_headings(own, text, want):
    got = own.section(text)
    assert (got and [(x["city"], x["country"]) for x in got]) == want


def test_several_texts_in_spark(spark):
    rows = [
        (1, ["Remote - Kenya", "Remote - Peru"], "x", "y"), (2, ["Remote - Kenya", "Hybrid - Lima"], None, None), (3, ["Lima - Remote", "Peru"], "", ""), (4, ["Kenya", "Worldwide"], "", ""), (5, [], "Oslo, Norway", ""), (6, None, "Clerk", "Location: Oslo, Norway"), (7, [None, ""], None, None),
    ]
    df = spark.createDataFrame(rows, "id int, raw array<string>, title string, text string")
    got = {r.id: (r.p.mode, r.p.scope, r.p.countries, [(x.city, x.country) for x in r.p.places or []]) for r in df.select("id", places.reader(places.gazetteer(spark))(F.col("raw"), F.col("title"), F.col("text")).alias("p")).collect()}
    assert got == {
        1: ("remote", "countries", ["KE", "PE"], [(None, "KE"), (None, "PE")]), 2: (None, "countries", ["KE", "PE"], [(None, "KE"), (None, None)]), 3: ("remote", "countries", ["PE"], [(None, None), (None, None)]), 4: ("remote", "worldwide", [], [(None, None), (None, None)]),
        5: (None, None, [], [("Oslo", "NO")]), 6: (None, None, [], [("Oslo", "NO")]), 7: (None, None, [], []),
    }


def test_a_larger_gazetteer(spark):
    more = places.gazetteer(spark).unionByName(spark.createDataFrame([(f"city number {i}", "city", "PE") for i in range(50_000)], "name string, kind string, code string"))
    df = spark.createDataFrame([(["Remote - City  Number 49999"],)], "raw array<string>")
    got = df.select(places.reader(more)(F.col("raw"), F.lit(""), F.lit("")).alias("p")).first().p
    assert (got.mode, got.countries) == ("remote", ["PE"])
