import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomfield.llm import sharding as sh

SCHEMA = "doc_id long, text string, shard string, _cell int"


def chances(good, bad, drawn):
    total = math.comb(good + bad, drawn)
    return {k: math.comb(good, k) * math.comb(bad, drawn - k) / total for k in range(max(0, drawn - bad), min(drawn, good) + 1)}


@pytest.mark.parametrize(("good", "bad", "drawn"), [(5, 7, 4), (1, 9, 3), (20, 3, 21), (300, 500, 60), (0, 4, 2), (4, 0, 4)])
def test_hypergeometric_has_its_law(good, bad, drawn):
    rng, n = np.random.default_rng(1), 20_000
    got, want = Counter(sh.hypergeometric(rng, good, bad, drawn) for _ in range(n)), chances(good, bad, drawn)
    assert set(got) <= set(want)
    common = {k: p for k, p in want.items() if p * n >= 5}
    chi = sum((got[k] - p * n) ** 2 / (p * n) for k, p in common.items())
    assert chi < len(common) + 5 * math.sqrt(2 * len(common)) + 8


def test_hypergeometric_of_huge_numbers():
    rng = np.random.default_rng(2)
    got = np.array([sh.hypergeometric(rng, 3 * 10**12, 10**12, 10**6) for _ in range(300)])
    assert abs(got.mean() - 750_000) < 5 * 433 / math.sqrt(300) and 350 < got.std() < 520


def test_matrix_margins_and_uniformity():
    counts, sizes = [5, 0, 7, 1, 10], sh.shard_sizes(23, 4)
    assert sizes == [5, 6, 6, 6] and sh.shard_sizes(0, 3) == [0, 0, 0] and sh.shard_sizes(2, 4) == [0, 1, 0, 1]
    for seed in range(40):
        m = sh.draw_matrix(counts, sizes, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
    # Two partitions of two rows, two shards of two: the matrices ((2,0),(0,2)), ((1,1),(1,1)) and ((0,2),(2,0)) have chances 1/6, 4/6, 1/6.
    seen = Counter(int(sh.draw_matrix([2, 2], [2, 2], s)[0, 0]) for s in range(6000))
    assert abs(seen[0] - 1000) < 150 and abs(seen[1] - 4000) < 200 and abs(seen[2] - 1000) < 150


def test_every_row_may_go_everywhere(spark):
    """The orders of four rows from two partitions over 480 seeds: all 24 come out, none far too often."""
    seen = Counter()
    for seed in range(480):
        m, cells = sh.draw_matrix([2, 2], [2, 2], seed), np.array([1, 1])
        plans = [sh.local_plan(seed, i, m[i], cells) for i in (0, 1)]
        rows = sorted((s, k, f"{i}{n}") for i, (shard, key, _) in enumerate(plans) for n, (s, k) in enumerate(zip(shard.tolist(), key.tolist(), strict=True)))
        seen[tuple(r[2] for r in rows)] += 1
    assert len(seen) == 24 and max(seen.values()) < 45


def rows_of(n, seed=3):
    rng = random.Random(seed)
    return [(rng.choice([None, i, i // 2]), rng.choice([None, "", "ä" * (i % 50), f"text {i}", "copy"]), "clash", i) for i in range(n)]


@pytest.mark.parametrize(("n", "shards", "cell_rows", "parts"), [(1000, 16, 7, 5), (3, 16, 4096, 4), (200, 3, 1, 3), (50, 1, 10, 2)])
def test_rows_stay_whole_in_shards_of_exact_sizes(spark, n, shards, cell_rows, parts):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).persist()
    got = sh.shuffle(df, shards, seed=4, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r.text, r._cell) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    by = {j: sorted(r.slot for r in got if r.shard == j) for j in range(shards)}
    assert [len(by[j]) for j in range(shards)] == sh.shard_sizes(n, shards)
    assert all(by[j] == list(range(len(by[j]))) for j in range(shards))
    again = sh.shuffle(df, shards, seed=4, cell_rows=cell_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    if n == 1000:
        assert sorted(map(str, sh.shuffle(df, shards, seed=5, cell_rows=cell_rows).collect())) != sorted(map(str, got))
        assert [r._cell for r in sorted(got, key=lambda r: (r.shard, r.slot))] != sorted(r._cell for r in got)


def test_empty_tables_and_unstable_input(spark):
    df = spark.createDataFrame(rows_of(30), SCHEMA)
    assert sh.shuffle(df.limit(0), 4).collect() == []
    assert sh.report(df.limit(0)).collect() == []
    got = sh.shuffle(df.orderBy("_cell").repartition(3), 4, stable=False).collect()
    assert sorted(r._cell for r in got) == list(range(30))


def test_partitions_that_change_end_the_job(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(30), SCHEMA).repartition(2).persist()
    monkeypatch.setattr(sh, "_counts", lambda d: [10, 20])
    with pytest.raises(Exception, match="between two passes"):
        sh.shuffle(df, 4).collect()


def test_report(spark):
    rows = rows_of(100)
    got = sh.report(spark.createDataFrame(rows, SCHEMA).repartition(2).persist()).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
