"""The archive's references, its commits, and polls as a stream that starts again where it was."""

import json

import pytest
from pyspark.sql import functions as F

from loomfield.sources import archive, polls


def rows(spark, n=200):
    return spark.range(n).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("2026-01-0"), F.col("id") % 3 + 1).alias("day"), (F.col("id") % 4).cast("int").alias("shard"), F.concat(F.lit("body é\n"), F.col("id")).alias("body"))


def save(df, folder):
    df.sparkSession.dataSource.register(archive.RawArchive)
    df.write.format("raw_archive").option("path", folder).mode("append").save()


def test_each_reference_reads_its_own_row(spark, tmp_path):
    folder = f"{tmp_path}/raw"
    save(archive.by_file(rows(spark)), folder)
    save(rows(spark, 210).where("id >= 200"), folder)
    found = archive.refs(spark, folder)
    assert found.count() == 210 and found.select("ref").distinct().count() == 210
    back = {r.ref: json.loads(r.row) for r in archive.lines(spark, folder, found).collect()}
    for r in found.collect():
        assert back[r.ref]["key"] == r.key and back[r.ref]["body"] == f"body é\n{r.key}" and f"raw-{back[r.ref]['day']}/shard-{back[r.ref]['shard']}-" in r.ref
    odd = spark.createDataFrame([("run-x/raw-1/a.gz#1",), (found.first().ref.split("#")[0] + "#99999",)], "ref string")
    assert [r.row for r in archive.lines(spark, folder, odd).collect()] == [None, None]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/raw"
    save(archive.by_file(rows(spark, 20)), folder)
    bad = archive.by_file(rows(spark)).withColumn("body", F.when(F.col("key") == "77", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        save(bad, folder)
    assert archive.refs(spark, folder).count() == 20
    assert len(list((tmp_path / "raw").glob("run-*"))) == 1
    save(rows(spark, 0), folder)
    assert archive.refs(spark, folder).count() == 20 and archive.refs(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="key"):
        save(rows(spark).drop("key"), folder)


def put(folder, board, poll, *said):
    (folder / str(board)).mkdir(parents=True, exist_ok=True)
    (folder / str(board) / f"{poll:08d}.jsonl").write_text("\n".join(said))


def test_polls_stream_once_each_and_go_on(spark, tmp_path):
    folder, ok = tmp_path / "in", lambda n: json.dumps({"ats": "lever", "slug": "s", "http_status": 200, "body": f"[{n}]"})
    put(folder, 1, 0, ok(0), "{cut")
    put(folder, 2, 5, ok(5), json.dumps([1]), json.dumps({"body": "x"}), "")
    (folder / "2" / "notes.txt").write_text("no poll")
    spark.dataSource.register(polls.PollStream)

    def run():
        stream = spark.readStream.format("board_polls").option("path", str(folder)).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.board_id, r.poll, r.line, r.http_status, r.degraded, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [(1, 0, 1, 200, False, None), (1, 0, 2, None, True, "not json"), (2, 5, 1, 200, False, None), (2, 5, 2, None, True, "not a response"), (2, 5, 3, None, True, "no status")]
    assert run() == first
    assert run() == first
    put(folder, 1, 1, ok(1))
    put(folder, 3, 0, ok(3))
    assert run() == sorted([*first, (1, 1, 1, 200, False, None), (3, 0, 1, 200, False, None)])


def test_partitions_between_two_offsets_are_the_same_again(tmp_path):
    for poll in range(4):
        put(tmp_path, 1, poll, "{}")
    reader = polls.PollReader({"path": str(tmp_path), "polls": "2"})
    assert reader.latestOffset() == {"1": 1} and reader.latestOffset() == {"1": 3}
    for _ in range(2):
        assert [(p.board, p.polls) for p in polls.PollReader({"path": str(tmp_path)}).partitions({"1": 0}, {"1": 2})] == [("1", [1, 2])]
    assert polls.PollReader({"path": f"{tmp_path}/none"}).latestOffset() == {}
