import gzip
import json

import pytest
from pyspark.sql import functions as F

from loomfield.functions import places
from loomfield.operators import ladder


def documents(spark, rows):
    df = spark.createDataFrame(rows, "source string, source_id string, raw_document_id long, title string, body string")
    return df.withColumn("job", F.parse_json("body")).drop("body")


def test_process_is_idempotent_and_fills_unknowns(spark):
    job = lambda text, **more: json.dumps({"location": {"name": "Pune"}, "content": text, **more})
    batch = documents(spark, [("greenhouse", "1", 5, "Junior Developer", job("Salary ₹6 LPA. This is a remote role. Freshers welcome")), ("greenhouse", "1", 4, "Old", job("old")), ("greenhouse", "2", 1, "Sales Intern", job("x"))])
    empty = ladder.decide(ladder.apply_rules(ladder.board_fields.fields(batch.where("1 = 0"), "greenhouse").drop("job")))
    once = ladder.process(empty, batch, "greenhouse")
    got = {r.source_id: r for r in once.collect()}
    assert got["1"].title == "Junior Developer" and got["1"].remote_type == "remote" and got["1"].remote_type_provenance == "rule"
    assert tuple(got["1"].pay) == (600000.0, 600000.0, "INR", "year") and got["1"].entry_level == "yes" and got["1"].role_family == "software-engineering"
    assert got["2"].employment_kind == "internship" and got["2"].pay_provenance == "unknown"
    older = documents(spark, [("greenhouse", "1", 3, "Older", job("older"))])
    again = ladder.process(ladder.process(once, batch, "greenhouse"), older, "greenhouse")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_rules_fill_never_override_and_recheck_is_stable(spark):
    rows = spark.createDataFrame([(1, "Dev", "A hybrid schedule.", "remote"), (2, "Dev", "A hybrid schedule.", None)], "id long, title string, description string, remote_type string")
    done = ladder.apply_rules(rows)
    got = {r.id: (r.remote_type, r.remote_type_provenance, r.rule_conflicts) for r in done.collect()}
    assert got == {1: ("remote", "source", ["remote_type"]), 2: ("hybrid", "rule", [])}
    assert {r.id: (r.remote_type, r.remote_type_provenance) for r in ladder.recheck(done).collect()} == {1: ("remote", "source"), 2: ("hybrid", "rule")}


def test_pending_rows_are_decided_again(spark):
    rows = spark.createDataFrame([(1, "Software Intern", "x"), (2, "Dev", "x")], "id long, title string, description string")
    done = ladder.decide(rows)
    stale = done.withColumn("decision_key", F.when(F.col("id") == 1, "decide:0").otherwise(F.col("decision_key"))).withColumn("employment_kind", F.lit("stale"))
    got = {r.id: (r.employment_kind, r.decision_key) for r in ladder.decide_pending(stale).collect()}
    assert got == {1: ("internship", f"decide:{ladder.VERSION}"), 2: ("stale", f"decide:{ladder.VERSION}")}


@pytest.mark.parametrize(("place", "remote", "countries", "scope"), [
    ("Remote - India", True, ["IN"], "countries"), ("Pune, India or Berlin, Germany", False, ["DE", "IN"], "countries"), ("Remote, North America", True, ["CA", "US"], "regions"), ("Anywhere", True, [], "worldwide"),
    ("Worldwide", False, [], None), ("Nowhere", False, [], None), (None, False, [], None),
])
def test_places(spark, place, remote, countries, scope):
    got = spark.createDataFrame([(place,)], "p string").select(ladder.read_place(F.col("p")).alias("y")).first().y
    assert (got.remote, got.countries, got.scope) == (remote, countries, scope)


def test_page_data_goes_first(spark):
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"T","jobLocationType":"TELECOMMUTE","hiringOrganization":{"name":"Co"}}</script>'
    rows = spark.createDataFrame([(1, "hybrid", None, page), (2, "hybrid", "B", "")], "id long, remote_type string, company_name string, html string")
    rows = rows.withColumns({"posted_at": F.lit(None).cast("timestamp"), "deadline_at": F.lit(None).cast("timestamp"), "description": F.lit(None).cast("string")})
    got = {r.id: (r.remote_type, r.company_name, r.conflicts) for r in ladder.with_page_data(rows, "id", "html").collect()}
    assert got == {1: ("remote", "Co", ["remote_type"]), 2: ("hybrid", "B", [])}


NOW = "2026-06-01 00:00:00"
LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"Page Title","jobLocationType":"TELECOMMUTE","datePosted":"2030-01-01","employmentType":"FULL_TIME","description":"<p>Apply</p>","applicantLocationRequirements":[{"name":"India"},{"name":"Kenya"}],"hiringOrganization":{"name":"Co"}}</script>'
RAW = [
    (1, "greenhouse", "b/1", json.dumps({"title": "Clerk", "location": {"name": "Remote - Kenya"}, "content": "Be kind."}), None), (2, "lever", "b/2", json.dumps([{"text": "Painter", "workplaceType": "hybrid", "descriptionPlain": "On site."}]), None),
    (3, "ashby", "b/3", json.dumps({"jobs": [{"title": "Cook (Remote - Peru)", "location": "In-Office"}]}), None), (4, "careerpage", "b/4", "<html>" + LD, None), (5, "greenhouse", "b/5", json.dumps({"title": "Board Title", "content": LD}), None),
    (6, "lever", "b/6", '{"text": "cut', None), (7, "workable", "b/7", "[1, 2]", None), (8, "careerpage", "b/8", "<html>no data", None), (9, "elsewhere", "b/9", "{}", None), (10, "lever", "b/10", None, None), (11, "lever", "b/11", "gz", b"\x1f\x8bbroken"),
    (12, "lever", "b/12", "gz", gzip.compress(json.dumps({"text": "Packed"}).encode())), (13, "himalayas", "b/13", json.dumps({"title": "X", "description": "This role isn't a fit for fully remote working."}), None), (14, "recruitee", "b/14", json.dumps({"id": 1}), None),
]


def raw(spark, rows=RAW):
    body = lambda r: r[4] if r[4] is not None else None if r[3] is None else r[3].encode()
    return spark.createDataFrame([(r[0], r[1], r[2], "text/html", body(r)) for r in rows], "raw_document_id long, source string, source_key string, content_type string, body binary")


def test_every_document_becomes_a_posting_or_is_quarantined(spark):
    good, bad = ladder.extract(raw(spark), NOW, places.gazetteer(spark))
    got = {r.raw_document_id: r for r in good.collect()}
    assert {r.raw_document_id: (r.reason, r.attempts) for r in bad.collect()} == {6: ("not_json", 1), 7: ("not_an_object", 1), 8: ("no_posting", 1), 9: ("unknown_source", 1), 10: ("no_body", 1), 11: ("bad_gzip", 1)}
    assert sorted(got) == [1, 2, 3, 4, 5, 12, 13, 14]
    assert (got[1].title, got[1].source_id, got[1].remote_type, got[1].remote_type_provenance, got[1].eligible_countries) == ("Clerk", "1", "remote", "rule", ["KE"])
    assert (got[2].title, got[2].remote_type, got[2].remote_type_provenance, got[2].rule_conflicts) == ("Painter", "hybrid", "source", ["remote_type"])
    assert (got[3].remote_type, got[3].places, got[3].eligible_countries, got[3].rule_conflicts) == ("onsite", None, ["PE"], ["locations: a way of work is no place"])
    assert (got[4].title, got[4].remote_type_provenance, str(got[4].posted_at), got[4].eligible_countries, got[4].eligibility_scope_provenance, got[4].description, got[4].employment_type, got[4].india_eligible) == ("Page Title", "jsonld", NOW, ["IN", "KE"], "jsonld", "Apply", ["FULL_TIME"], "yes")
    assert (got[5].title, got[5].company_name, got[5].conflicts[0]) == ("Page Title", "Co", "title") and got[12].title == "Packed"
    assert (got[13].remote_type, got[13].remote_type_provenance, got[13].rule_conflicts) == (None, "unknown", ["remote_type"]) and (got[14].title, got[14].conflicts) == ("b/14", ["title: missing"])


def test_quarantine_is_tried_again_and_left(spark):
    names = ["source", "source_id", "raw_document_id", "title"]
    empty = spark.createDataFrame([], "source string, source_id string, raw_document_id long, title string")
    held = spark.createDataFrame([(6, "lever", "b/6", "not_json", 2), (7, "workable", "b/7", "not_an_object", 3), (12, "lever", "b/12", "bad_gzip", 1)], "raw_document_id long, source string, source_key string, reason string, attempts int")
    rows = [r for r in RAW if r[0] in (6, 7, 12)]
    after, left = ladder.process_documents(empty, raw(spark, rows), NOW, held)
    assert [tuple(r[n] for n in names) for r in after.collect()] == [("lever", "12", 12, "Packed")]
    assert {r.raw_document_id: (r.reason, r.attempts) for r in left.collect()} == {6: ("not_json", 3), 7: ("not_an_object", 3)}


def test_versions_take_back_what_a_source_got_wrong(spark):
    rows = spark.createDataFrame(
        [(1, "ashby", 7, "remote", "source", None, "unknown"), (2, "ashby", 8, "remote", "source", None, "unknown"), (3, "himalayas", 8, "remote", "source", "worldwide", "source"), (4, "himalayas", None, "remote", "manual", "worldwide", "manual")],
        "id long, source string, extraction_version int, remote_type string, remote_type_provenance string, eligibility_scope string, eligibility_scope_provenance string",
    )
    got = {r.id: (r.remote_type, r.remote_type_provenance, r.eligibility_scope, r.eligibility_scope_provenance) for r in ladder.recheck(rows.withColumns({"title": F.lit("x"), "description": F.lit("y")})).collect()}
    assert got == {1: (None, "unknown", None, "unknown"), 2: ("remote", "source", None, "unknown"), 3: ("remote", "source", None, "unknown"), 4: ("remote", "manual", "worldwide", "manual")}
