import numpy as np
import pytest

from loomfield.llm import graph_search as gs

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good.setdefault(i, set()).add(tuple(v))
    out = {}
    for q in good:
        if q % every == 0:
            own = np.array(min(good[q]), float)
            scored = sorted((-float((np.array(v) * own).sum()), i) for i, vs in good.items() if i != q for v in vs)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    out = [(i, [float(x) for x in v[i]]) for i in range(n)]
    out += [(1000 + i, out[3][1]) for i in range(60)] + [(5, out[5][1]), (2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] + [0.0] * 7), (2006, [1.0] * 5), (None, out[1][1])]
    return out


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(gs, "LEAST", 100)  # several shards
    data = rows()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in data], SCHEMA).repartition(3)
    want = brute(data, 20, 20)
    got = {}
    for r in sorted(gs.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert q not in [i for i, _ in found]


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (20, [1.0, 0.0], 0, ""), (7, [0.0, 2.0], 0, "")], SCHEMA)
    assert sorted(tuple(r) for r in gs.nearest(df).collect()) == [(0, 1, 20, 1.0), (0, 2, 7, 0.0), (20, 1, 0, 1.0), (20, 2, 7, 0.0)]
    assert gs.nearest(df.limit(0)).collect() == []
    assert gs.nearest(df.where("vec_id = 7")).collect() == []
    assert gs.nearest(spark.createDataFrame([(0, [1.0], 0, "")], SCHEMA)).collect() == []


def test_graphs_hold_copies_and_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.1 + c for c in (0, 10, -10)]).astype(np.float32)
    g = gs.Graph(x)
    g.build()
    found, _ = g.search(x[::10], 32)
    true = ((x[::10][:, None] - x[None]) ** 2).sum(2).argsort(1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) > 0.95


def test_shards_are_bounded_by_vectors_and_bytes():
    assert gs.shards_for(1, 64) == 1 and gs.shards_for(51_282, 64) == 12
    assert gs.shards_for(10**9, 64) == -(-(10**9) // gs.MOST)
    for dim in (64, 768, 4096):
        per = 10**8 / gs.shards_for(10**8, dim)
        assert per <= gs.MOST and per * 24 * dim <= gs.SHARD_BYTES


def test_recall_at_sixty_four_components(spark):
    """One shard of clustered vectors of unlike length, against brute force."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 64))
    v *= rng.uniform(0.5, 2, size=(4000, 1))
    got = {}
    for r in gs.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == list(range(0, 4000, 20))
    scores = v[::20] @ v.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[20 * i] & set(true[i].tolist())) / 20 for i in range(200)]) >= 0.9


def recall_of(spark, rows, parts=3, k=20):
    """Recall against brute force; every query must have k rows or all candidates."""
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(parts)
    got: dict[int, list] = {}
    for r in gs.nearest(df, k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = 0
    assert got.keys() == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:k]].tolist())
        assert sorted(r for r, _, _ in found) == list(range(1, min(k, len(rows) - 1) + 1))
        hits += len(best & {v for _, v, _ in found})
    return hits / sum(min(k, len(rows) - 1) for _ in got)


def unit(rng, n, dim=32):
    v = rng.normal(size=(n, dim))
    return v / np.sqrt((v * v).sum(1))[:, None]


@pytest.mark.parametrize("norms", [[1e4], [1e8], [1e2, 1e3, 1e4, 1e6], [1e20] * 10, [1e-20] * 10, [5e-324, 1e150, 1e-150]])
def test_outlying_norms_cost_no_rows(spark, norms):
    rng = np.random.default_rng(3)
    v = unit(rng, 1500)
    for i, n in enumerate(norms):
        v[7 * i + 3] *= n
    assert recall_of(spark, [(i, x) for i, x in enumerate(v) if np.any(x)]) >= 0.95


@pytest.mark.parametrize("scale", [1e20, 1e-30, 1e150])
def test_all_norms_huge_or_tiny(spark, scale):
    assert recall_of(spark, list(enumerate(unit(np.random.default_rng(4), 1000) * scale))) >= 0.95


def test_far_clusters_are_entered(spark):
    rng = np.random.default_rng(5)
    centres = unit(rng, 3, 16) * 50
    v = np.concatenate([centres[0] + rng.normal(size=(1200, 16)), centres[1] + rng.normal(size=(300, 16)) * 0.01, centres[2] + rng.normal(size=(25, 16)) * 0.001])
    assert recall_of(spark, list(enumerate(rng.permutation(v)))) >= 0.95


def test_norms_over_many_powers_of_two(spark):
    rng = np.random.default_rng(6)
    assert recall_of(spark, list(enumerate(unit(rng, 1000, 8) * np.exp(rng.normal(size=(1000, 1)) * 8)))) >= 0.95


def test_parts_without_edges_are_entered():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    edges = np.full((500, gs.DEGREE), -1, np.int32)  # no edges at all
    found, _ = gs.Graph(x, edges).search(x[:20], 500)
    assert (np.sort(found, axis=1) == np.arange(500)).all()
