"""Steps from the command line over tables in versions."""

import json

import pytest
from pyspark.sql import functions as F

from loomfield import __main__ as cli
from loomfield.operators import ladder


def run(spark, capsys, *argv):
    assert cli.main(list(argv), spark) == 0
    return json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_steps(spark, tmp_path, capsys):
    data = f"file://{tmp_path}/data"
    store = cli.Store(spark, data)
    body = lambda x: json.dumps(x).encode()
    raw = [(1, "lever", "b/1", "", body({"text": "Python clerk", "descriptionPlain": "This is a remote role."})), (2, "lever", "b/2", "", b"{cut")]
    store.write("documents", spark.createDataFrame(raw, "raw_document_id long, source string, source_key string, content_type string, body binary"))
    assert run(spark, capsys, "process", "--data", data, "--now", "2026-06-01") == {"step": "process", "documents": 2, "postings": 1, "quarantined": 1}
    assert run(spark, capsys, "process", "--data", data, "--now", "2026-06-01")["postings"] == 1
    assert store.need("quarantine").first().attempts == 2
    stale = store.need("postings").withColumn("decision_key", F.lit("decide:0"))
    store.write("postings", stale)
    assert run(spark, capsys, "decide", "--data", data) == {"step": "decide", "postings": 1, "decided": 1}
    assert store.need("postings").first().decision_key == f"decide:{ladder.VERSION}"
    spark.createDataFrame([("python", "python", False)], "term string, skill string, exact_case boolean").write.parquet(f"{data}-terms")
    assert run(spark, capsys, "skills", "--data", data, "--input", f"{data}-terms") == {"step": "skills", "skills": 1, "postings": 1}


def test_small_steps(spark, tmp_path, capsys):
    data = f"file://{tmp_path}/data"
    store = cli.Store(spark, data)
    spark.createDataFrame([("lever", "Acme"), ("lever", "acme"), ("lever", "b b")], "ats string, slug string").write.parquet(f"{data}-list")
    assert [run(spark, capsys, "seed", "--data", data, "--input", f"{data}-list") for _ in "12"] == [{"step": "seed", "boards": 1, "new": 1}, {"step": "seed", "boards": 1, "new": 0}]
    store.write("links", spark.createDataFrame([(1, 1, False), (2, 0, False), (3, 1, False)], "id long, dead_checks int, dead boolean"))
    spark.createDataFrame([(1, 404), (2, 200)], "id long, http_status int").write.parquet(f"{data}-seen")
    assert run(spark, capsys, "linkcheck", "--data", data, "--input", f"{data}-seen") == {"step": "linkcheck", "links": 3, "dead": 1}
    store.write("polls", spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b")], "board_id long, at long, source_id string"))
    assert run(spark, capsys, "liveness", "--data", data) == {"step": "liveness", "closed": 1, "open": 1}
    assert run(spark, capsys, "query", "--data", "/root/testdata/sf0.001", "--name", "data_quality", "--output", f"{data}-out")["rows"] == 1
    for argv in (["query", "--data", data], ["process", "--data", data], ["nothing", "--data", data]):
        with pytest.raises(SystemExit):
            cli.main(argv, spark)
    with pytest.raises(SystemExit, match="no table"):
        cli.main(["decide", "--data", data], spark)
