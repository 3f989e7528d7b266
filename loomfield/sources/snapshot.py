"""A Python data source that reads saved board responses, and the archive sink they are written by."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "board_id long, ats string, slug string, http_status int, body string"


class Shard(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SnapshotReader(DataSourceReader):
    """One partition per shard of files; a file holds one response per line."""

    def __init__(self, options: dict):
        self.paths, self.shards = options["paths"].split(","), int(options.get("shards", "8"))

    def partitions(self) -> list[Shard]:
        return [Shard(own) for k in range(self.shards) if (own := self.paths[k :: self.shards])]

    def read(self, partition: Shard) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, encoding="utf-8") as f:
                for line in f:
                    try:
                        r = json.loads(line)
                        yield (int(r["board_id"]), r.get("ats"), r.get("slug"), int(r.get("http_status", 0)), r.get("body"))
                    except (ValueError, KeyError, TypeError):
                        continue


class SnapshotSource(DataSource):
    """``spark.read.format("board_snapshot").option("paths", "a,b").load()``: the plug-in point for fetching boards."""

    @classmethod
    def name(cls) -> str:
        return "board_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSource)


def with_archive_ref(rows: DataFrame, day: str, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with the stable place that each takes in its day's and shard's archive."""
    line = F.row_number().over(W.partitionBy(day, shard).orderBy(*order))
    return rows.withColumn("archive_ref", F.format_string("raw-%s/shard-%s.jsonl.gz#%d", F.col(day).cast("string"), F.col(shard).cast("string"), line))


def archive(rows: DataFrame, folder: str, day: str, shard: str) -> None:
    """Write rows as gzipped JSON lines by day and shard."""
    rows.write.partitionBy(day, shard).option("compression", "gzip").mode("append").json(folder)


def seed(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Boards of the list that are not stored yet; slugs match in any case, invalid and repeated ones are left out."""
    good = wanted.where(F.col("slug").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$")).withColumn("_slug", F.lower("slug")).dropDuplicates(["ats", "_slug"])
    return good.join(stored.select("ats", F.lower("slug").alias("_slug")), ["ats", "_slug"], "left_anti").drop("_slug")


def slug_candidates(name):
    """Slugs to try for a company's name: joined, dashed, without what follows the first word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.slice(F.array_distinct(F.array_compact(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(words, "_"), F.get(words, 0), F.concat(F.array_join(words, ""), F.lit("careers")), F.concat(F.get(words, 0), F.lit("hq"))))), 1, 6)
