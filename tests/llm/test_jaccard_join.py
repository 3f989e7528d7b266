import random

import numpy as np
import pytest

from loomfield.llm import jaccard_join as jj


def shingle_set(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """rows: (doc_id, text). (class, copy, links, text links) by doc_id."""
    sets = [shingle_set(t) for _, t in rows]
    texts = [t or "" for _, t in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a + 1, n):
            same = texts[a] == texts[b]
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                near[a, b] = near[b, a] = True
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i]] + [group[j] for j in np.flatnonzero(near[i])]) for i in range(n)]
        if new == group:
            break
        group = new
    out = []
    for a in range(n):
        cls = min(rows[b][0] for b in range(n) if texts[b] == texts[a])
        members = [rows[b][0] for b in range(n) if group[b] == group[a]]
        other = {texts[b] for b in np.flatnonzero(near[a])} - {texts[a]}
        out.append((rows[a][0], min(members), cls, int(near[a].sum()), len(other)))
    return sorted(out)


def fixture():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    rows, n = [], 0
    for size, copies in ((30, 3), (60, 40), (200, 25), (6, 4), (3, 3), (12, 2)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(size)] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + i, " ".join(rng.choice(words) for _ in range(50))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one\ttwo"), (905, "one two"), (906, "x" * 50_000)]
    return rows


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)  # large buckets are split into several blocks
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, class_id string").repartition(5)
    got = sorted(tuple(r) for r in jj.links(docs).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jj.links(docs).collect()) == [(1, 1, 1, 2, 0), (1, 1, 1, 2, 0), (2, 1, 1, 2, 0)]
    kept = jj.drop_near_copies(docs).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == [(False, 1), (True, 0), (True, 0)]
    assert jj.links(docs.limit(0)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = jj.choose_bands()
    assert bands * rows <= jj.MOST_HASHES
    assert 1 - (1 - jj.THRESHOLD**rows) ** bands >= jj.RECALL


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_counts_of_common_members(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(n)]
    a, b = np.triu_indices(n, 1)
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert (jj.common_counts(sets, a, b).tolist() if n else []) == want


def test_texts_that_share_an_id_stay_apart(spark):
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (3, "a b c d e f"), (3, "m n o p q r"), (3, "m n o p q r"), (5, near), (5, near + " x")]
    kept = jj.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 5) == [(1, "a b c d e f"), (1, "g h i j k l"), (3, "m n o p q r")]
    assert sum(r.doc_id == 5 for r in kept) == 1
