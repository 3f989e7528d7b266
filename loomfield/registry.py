"""Registered queries and their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder by name; each is read where it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str, *columns: str) -> DataFrame:
        """A table for costly expressions: if its files have fewer parts than there are cores (one large row group is one part,
        however long its texts take), its rows are dealt over all cores by ``key``. Tables of many parts are read as they are."""
        table = getattr(self, name)
        if columns:
            table = table.select(*columns)
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores, key) if table.rdd.getNumPartitions() < 2 * cores else table


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII string, bit by bit, as DuckDB has no function for it."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {byte}))"
