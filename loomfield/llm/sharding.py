"""Operator 12: shards of exact sizes in uniformly random order, by a hypergeometric communication matrix.

Of a uniform shuffle of all rows into shards of given sizes, the numbers of rows that go from each input partition to each shard
are a random matrix with fixed margins. The driver draws that matrix exactly, partition by partition, from the counts of rows
(``draw_matrix``): it holds partitions times shards whole numbers and no row. Each partition then permutes its shard numbers
locally, as many of each as the matrix says, and gives every row a random 63-bit key. Rows are exchanged, and each shard is
permuted again: its rows are sorted by key. Each shard is exchanged in cells, ranges of keys of about ``CELL_ROWS`` rows and
one task each, so no task holds a shard; how many rows a cell gets follows from the partitions' counts and seeds alone, so the
first slot of each cell is known from a pass that reads no data. Beyond ``MOST_CELLS`` cells of that size, cells grow.

A shard's size is the number of its rows: floor((j + 1) n / k) - floor(j n / k) of n rows for shard j of k, so sizes differ by one
at most (law ``rows``). Equal texts are rows of their own and fall where chance puts them.

Defined cases: null texts, null and repeated ids, and repeated rows are rows like others; an empty table gives no rows; input
columns pass through, but those named as the two outputs give way to them. The same seed and files give the same shards,
also when a lost executor's tasks run again. That needs input whose partitions come out alike in every pass: a scan of
files and narrow steps behind it. Anything else is written first (``stable=False``). Partitions that differ between passes
after all end the job with an error, as the matrix no longer holds for them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import free_name, written

#: Rows that a cell holds on average, as long as there are no more cells than that.
CELL_ROWS, MOST_CELLS = 4096, 32_768


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items out of good + bad are good. By inversion within 40 standard deviations of the mode, beyond
    which no double has weight; numbers may be of any size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    reach = int(40 * math.sqrt(drawn * (good / n) * (bad / n) * ((n - drawn) / max(1, n - 1)) + 1)) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    # The chance of k + 1 over that of k, summed as logarithms from the lower end.
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def shard_sizes(n: int, shards: int) -> list[int]:
    return [(j + 1) * n // shards - j * n // shards for j in range(shards)]


def draw_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows from each partition (``counts``) to each shard (``sizes``) in a uniform shuffle. A partition's row is drawn from what
    the shards still lack, shard by shard."""
    rng = np.random.default_rng([seed, 1])
    lacking, out = list(sizes), np.zeros((len(counts), len(sizes)), np.int64)
    for i, drawn in enumerate(counts):
        rest = sum(lacking)
        for j, good in enumerate(lacking):
            if not drawn:
                break
            rest -= good
            got = hypergeometric(rng, good, rest, drawn)
            out[i, j], lacking[j], drawn = got, good - got, drawn - got
    return out


def cells_of(sizes: list[int], cell_rows: int) -> np.ndarray:
    """Number of cells of each shard."""
    rows = max(cell_rows, -(-sum(sizes) // MOST_CELLS))
    return np.array([max(1, -(-n // rows)) for n in sizes], np.int64)


def local_plan(seed: int, partition: int, row: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, key and cell of each row of a partition, in the order in which it is read: the shards of its matrix row, permuted."""
    rng = np.random.default_rng([seed, 2, partition])
    shard = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
    key = rng.integers(0, 1 << 63, len(shard), dtype=np.int64)
    # The upper 31 bits times the number of cells, so cells are ranges of keys; they are numbered over all shards.
    return shard, key, (np.cumsum(cells) - cells)[shard] + (((key >> 32) * cells[shard]) >> 31)


def _counts(docs: DataFrame) -> list[int]:
    part = docs.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    found = {r["p"]: r["count"] for r in part.collect()}
    return [found.get(i, 0) for i in range(max(found, default=-1) + 1)]


def first_slots(spark: SparkSession, counts: list[int], matrix: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """First slot of each cell in its shard, from counts and seeds alone, as each partition's plan can be made anew."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                own, n = np.unique(local_plan(seed, i, matrix[i], cells)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["cell", "n"])

    parts = max(1, min(len(counts), 4 * spark.sparkContext.defaultParallelism))
    rows = np.zeros(int(cells.sum()), np.int64)
    for r in spark.range(0, len(counts), 1, parts).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        rows[r["cell"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(rows)])
    return before[:-1] - np.repeat(before[np.cumsum(cells) - cells], cells)


def shuffle(docs: DataFrame, shards: int, seed: int = 12, shard: str = "shard", slot: str = "slot", cell_rows: int = CELL_ROWS, stable: bool = True) -> DataFrame:
    """``docs`` with the columns ``shard`` (from 0) and ``slot`` (from 0 within the shard, without gaps): one uniformly random
    order of all rows, dealt to shards whose sizes differ by one at most."""
    docs = docs.drop(shard, slot)
    if not stable:
        docs = written(docs, "shuffle")
    spark, counts = docs.sparkSession, _counts(docs)
    sizes = shard_sizes(sum(counts), shards)
    matrix, cells = draw_matrix(counts, sizes, seed), cells_of(sizes, cell_rows)
    firsts = first_slots(spark, counts, matrix, cells, seed)
    cell_, key_ = (free_name(docs, n) for n in ("_cell", "_key"))
    width = len(docs.columns)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        i, at, plan = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if plan is None:
                plan = local_plan(seed, i, matrix[i] if i < len(matrix) else np.zeros(shards, np.int64), cells)
            end = at + batch.num_rows
            if end > len(plan[0]):
                raise RuntimeError("a partition has grown between two passes over the input; pass stable=False")
            own = [pa.array(x) for x in (plan[0][at:end], firsts[plan[2][at:end]].astype(np.int32), plan[2][at:end].astype(np.int32), plan[1][at:end])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), *own], names=[*batch.schema.names, shard, slot, cell_, key_])
            at = end
        if at != (counts[i] if i < len(counts) else 0):
            raise RuntimeError("a partition has shrunk between two passes over the input; pass stable=False")

    added = ((shard, T.IntegerType()), (slot, T.IntegerType()), (cell_, T.IntegerType()), (key_, T.LongType()))
    placed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added)]))
    number = F.row_number().over(W.partitionBy(cell_).orderBy(key_))
    dealt = placed.repartitionById(int(cells.sum()), F.col(cell_))  # each task one cell; the window needs no other exchange
    return dealt.withColumn(slot, F.col(slot) + number - 1).drop(cell_, key_)


def report(docs: DataFrame, shards: int = 16, seed: int = 12) -> DataFrame:
    """Ids, sizes and checksums of the rows as their shards hold them."""
    done = shuffle(docs.select("doc_id", F.col("text").cast("string").alias("text")), shards, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    return done.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
