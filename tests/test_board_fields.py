import json

import pytest
from pyspark.sql import functions as F

from loomfield.functions import answers, board_fields

JOBS = {
    "greenhouse": ({"location": {"name": "Pune"}, "absolute_url": "u", "first_published": "2026-01-02T00:00:00Z", "content": "&lt;p&gt;Hi&lt;/p&gt;"}, {"places": ["Pune"], "apply_url": "u", "description": "Hi"}),
    "lever": ({"categories": {"location": "Berlin", "commitment": "Full Time/Contract"}, "workplaceType": "On-site", "hostedUrl": "h", "createdAt": 1767312000000, "descriptionPlain": "d", "lists": [{"text": "T", "content": "<li>x"}], "salaryRange": {"min": 1, "max": 2, "currency": "eur", "interval": "per-year-salary"}},
              {"employment_type": ["full_time", "contract"], "remote_type": "onsite", "apply_url": "h", "pay": (1.0, 2.0, "EUR", "year")}),
    "ashby": ({"location": "A", "secondaryLocations": [{"location": "B"}, {"location": "A"}], "workplaceType": "Hybrid", "isRemote": True, "employmentType": "odd"}, {"places": ["A", "B"], "remote_type": "hybrid", "employment_type": ["other"]}),
    "workable": ({"city": "X", "country": "Y", "telecommuting": True, "experience": "Entry level"}, {"places": ["X, Y"], "remote_type": "remote", "seniority": "entry"}),
    "recruitee": ({"remote": True, "hybrid": True, "employment_type_code": "fulltime_permanent", "translations": {"en": {"description": "<b>t</b>"}}}, {"remote_type": None, "employment_type": ["full_time"], "description": "t"}),
    "smartrecruiters": ({"id": "7", "company": {"identifier": "Co"}, "location": {"city": "P", "country": "in", "hybrid": True}, "experienceLevel": {"label": "Mid-Senior Level"}}, {"apply_url": "https://jobs.smartrecruiters.com/Co/7", "remote_type": "hybrid", "seniority": "mid"}),
    "himalayas": ({"locationRestrictions": ["India", "North America"], "seniority": ["Entry-level", "Senior"], "pubDate": 1767312000, "expiryDate": 5, "guid": "https://g", "minSalary": 10, "salaryPeriod": "Annual", "currency": "usd"}, {"eligible_countries": ["CA", "IN", "US"], "seniority": None, "deadline_at": None, "apply_url": "https://g", "pay": (10.0, None, "USD", "year")}),
}


@pytest.mark.parametrize("ats", JOBS)
def test_mappers(spark, ats):
    job, want = JOBS[ats]
    df = spark.createDataFrame([(json.dumps(job),), ("{}",), ('{"location": 5, "categories": [], "locations": "x", "salary": 3}',)], "body string").select(F.parse_json("body").alias("job"))
    rows = board_fields.fields(df, ats).drop("job").collect()
    assert len(rows) == 3
    for key, value in want.items():
        got = rows[0][key]
        assert (tuple(got) if isinstance(value, tuple) else got) == value, key


def test_answers_need_quotes(spark):
    schema = "remote_type string, remote_type_quote string, eligibility_scope string, eligibility_quote string, eligible_countries array<string>, visa_sponsorship string, visa_quote string, experience_min_years int, experience_max_years int, experience_quote string"
    text = "This role is fully  Remote. Must be located in IN. 2 to 4 years needed."
    cases = [("remote", "fully remote", "countries", "must be located in IN", ["IN"], "yes", "not there", 2, 4, "2 to 4 years"), ("hybrid", "fully remote", "worldwide", "must be located in IN", [], "unknown", "", 3, None, "2 to 4 years")]
    df = spark.createDataFrame([(c,) for c in cases], f"a struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>")
    got = [tuple(r.y) for r in df.select(answers.checked(F.col("a"), F.lit(text)).alias("y")).collect()]
    assert got == [("remote", "countries", None, 2, 4), (None, None, None, None, None)]


@pytest.mark.parametrize("reply", ['{"a":1}', '```json\n{"a":1,"b":2}\n```', '<think>{"a":9</think> {"a":1}', 'Sure: {"a":1} ok'])
def test_json_objects(spark, reply):
    assert spark.createDataFrame([(reply,)], "r string").select(answers.json_object(F.col("r"), "a int").alias("y")).first().y.a == 1


def test_json_objects_and_phrases(spark):
    df = spark.createDataFrame([("[1]",), ("none",), (None,)], "r string")
    assert [r.y for r in df.select(answers.json_object(F.col("r"), "a int").alias("y")).collect()] == [None] * 3
    two = spark.createDataFrame([("C", "React"), ("C", "uses C, Go"), ("c++", "C++ dev")], "v string, t string")
    assert [r.y for r in two.select(answers.in_text(F.col("v"), F.col("t")).alias("y")).collect()] == [False, True, True]
    assert answers.ask(df, None, "r").where("reply is not null").count() == 0
    assert answers.ask(df, str.upper, "r").where("reply = 'NONE'").count() == 1
