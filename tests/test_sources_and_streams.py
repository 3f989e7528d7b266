import datetime as dt
import json

from pyspark.sql import functions as F

from loomfield.operators import state
from loomfield.sources import boards, snapshot
from loomfield.streaming import events


def test_snapshot_source_lists_postings(spark, tmp_path):
    body = json.dumps({"jobs": [{"id": 1, "absolute_url": "u1"}, {"absolute_url": "no id"}, {"id": "x", "absolute_url": "u2"}]})
    lines = [{"board_id": 1, "ats": "greenhouse", "slug": "a", "http_status": 200, "body": body}, {"board_id": 2, "ats": "greenhouse", "slug": "b", "http_status": 404, "body": ""}, {"board_id": 3, "ats": "greenhouse", "slug": "c", "http_status": 200, "body": "<html>"}]
    for i, x in enumerate(lines):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps(x) + "\nbroken\n")
    snapshot.register(spark)
    df = spark.read.format("board_snapshot").option("paths", ",".join(str(tmp_path / f"{i}.jsonl") for i in range(3))).option("shards", "2").load()
    status = {r.board_id: r.s for r in df.select("board_id", boards.poll_status(F.col("http_status"), F.col("body")).alias("s")).collect()}
    assert status == {1: "ok", 2: "dead", 3: "degraded"}
    assert sorted((r.board_id, r.source_id, r.url) for r in boards.listed(df, "greenhouse").collect()) == [(1, "1", "u1"), (1, "x", "u2")]


def test_unlisted_postings_and_bare_lists(spark):
    ashby = spark.createDataFrame([('{"jobs":[{"id":"a","jobUrl":"u","isListed":false},{"id":"b","jobUrl":"v"}]}',), (None,)], "body string")
    assert [r.source_id for r in boards.listed(ashby, "ashby").collect()] == ["b"]
    lever = spark.createDataFrame([('[{"id":"l","hostedUrl":"h"}]',), ("[]",)], "body string")
    assert [r.source_id for r in boards.listed(lever, "lever").collect()] == ["l"]


def test_archive_and_seed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01", 0, "b"), (2, "2024-01-01", 0, "a"), (3, "2024-01-02", 1, "c")], "id long, day string, shard int, k string")
    refs = {r.id: r.archive_ref for r in snapshot.with_archive_ref(rows, "day", "shard", ["k"]).collect()}
    assert refs[2] == "raw-2024-01-01/shard-0.jsonl.gz#1" and refs[1].endswith("#2")
    snapshot.archive(rows, str(tmp_path / "a"), "day", "shard")
    assert spark.read.json(str(tmp_path / "a")).count() == 3
    stored = spark.createDataFrame([("lever", "Acme")], "ats string, slug string")
    wanted = spark.createDataFrame([("lever", "acme"), ("lever", "Beta"), ("lever", "beta"), ("lever", "bad slug")], "ats string, slug string")
    assert [r.slug.lower() for r in snapshot.seed(stored, wanted).collect()] == ["beta"]
    assert spark.range(1).select(snapshot.slug_candidates(F.lit("Acme Labs, Inc."))).first()[0] == ["acmelabsinc", "acme-labs-inc", "acme_labs_inc", "acme", "acmelabsinccareers", "acmehq"]


def test_shards_and_due(spark):
    import zlib

    df = spark.range(20).select(boards.shard_of(F.col("id"), 8).alias("s"), "id")
    assert all(r.s == zlib.crc32(str(r.id).encode()) % 8 for r in df.collect())


def stream(spark, rows, schema, tmp_path, build, parts=2):
    """Run a streaming query over files written one by one; all rows it has put out."""
    folder = tmp_path / "in"
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = str(tmp_path / "out")
    q = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_streamed_dedupe(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "a"), (2, t, "b"), (1, t, "a"), (3, t + dt.timedelta(minutes=1), "c")]
    got = stream(spark, rows, "id long, ts timestamp, k string", tmp_path, lambda s: events.dedupe(s, ["id", "k"], "ts", "1 hour"))
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_streamed_liveness_closes_at_the_second_miss(spark, tmp_path):
    t = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    rows = [(1, t[0], ["a", "b"]), (1, t[1], ["a"]), (1, t[2], ["a"]), (1, t[3], ["a", "b"])]
    got = stream(spark, rows, "board long, at timestamp, items array<string>", tmp_path, events.liveness, parts=1)
    by = {(r.at.day, r.item): (r.missing_polls, r.status) for r in got}
    assert by[(2, "b")] == (1, "open") and by[(3, "b")] == (2, "closed") and by[(4, "b")] == (0, "open") and by[(3, "a")] == (0, "open")


def test_upsert_batches_replay(spark):
    stored = [spark.createDataFrame([(1, "a", 1)], "k long, v string, raw long")]
    step = events.upsert_batches(lambda: stored[-1], stored.append, ["k"], "raw")
    batch = spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k long, v string, raw long")
    step(batch, 0)
    step(batch, 0)
    assert sorted(tuple(r) for r in stored[-1].collect()) == [(1, "b", 2), (2, "c", 1)]
    assert state.CLOSE_AFTER == 2
