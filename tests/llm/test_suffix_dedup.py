import hashlib
import random

import numpy as np
import pytest
import xxhash

from loomfield.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, k string"


def tie(text):
    return (xxhash.xxh64((text or "").encode(), seed=42).intdigest() ^ (1 << 63)) - (1 << 63)


def brute(rows, length=100):
    """rows: (doc_id, text). Result rows of distinct documents in their order."""
    seen, out = set(), []
    for doc, _, text in sorted({(d, tie(t), t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passages = [text(rng.choice([98, 100, 101, 150, 400])) for _ in range(6)]
    rows = []
    for i in range(60):
        body = ""
        for _ in range(rng.randrange(4)):
            body += text(rng.randrange(200))
            p = rng.choice(passages)
            a = rng.choice([0, 0, 0, rng.randrange(40)])
            body += p[a : len(p) - rng.choice([0, 0, rng.randrange(40)])]
        rows.append((i, body + text(rng.randrange(60))))
    rows += [(60, None), (61, ""), (62, "a" * 500), (63, "ab" * 300), (64, rows[3][1]), (65, rows[3][1]), (66, "x" * 99), (67, "x" * 99), (68, "x" * 100)]
    rows.append((-5, "before " + passages[0] + " all"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(sd, "PIECE", 256)  # texts are cut into pieces
    rows = fixture(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in sd.removed(docs).collect()) == brute(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_shared_null_and_repeated_ids_match_brute_force(spark, monkeypatch, hot):
    if hot:  # every symbol of two texts is dealt
        monkeypatch.setattr(sd, "HOT_LEAST", 2)
        monkeypatch.setattr(sd, "SALTS", 3)
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 1, 2, 2, 7, i]), t) for i, t in fixture(3)]
    rows += [rows[4]] * 3 + [rows[9]] * 2 + [(None, rows[4][1])]
    got = sd.removed(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)).collect()
    by = lambda r: (r[0] is not None, *(x or 0 for x in r[:4]), r[4])
    assert len(got) == len(rows)
    assert sorted({tuple(r) for r in got}, key=by) == sorted(set(brute(rows)), key=by)


def test_texts_under_one_id_are_all_searched(spark):
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    rows = [(None, a), (None, b), (1, a + "x" * 40), (2, b + "y" * 40), (3, "q" * 40 + a), (3, b)]
    got = sd.removed(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 300, 0), (0, 300, 0), (1, 340, 300), (2, 340, 300), (3, 300, 300), (3, 340, 300)]


def test_an_empty_table_gives_no_rows(spark):
    assert sd.removed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_intervals_merge():
    a, z = sd.merged(np.array([5, 0, 3, 20]), np.array([9, 4, 5, 30]))
    assert (a.tolist(), z.tolist()) == ([0, 20], [9, 30])
