import hashlib
import random
import zlib

import numpy as np

from loomfield.llm import periodic_runs as pr


def plain_runs(words):
    """Every run by comparing all words at all distances."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in best.items())


def some_text(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 400)
    letters = "abcdefghij"[: rng.randrange(1, 10)]
    out = [rng.choice(letters) for _ in range(n)]
    for _ in range(kind):
        word = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 30, 60, 90]))]
        at = rng.randrange(len(out) + 1)
        out[at:at] = (word * 12)[: rng.randrange(1, 6 * len(word) + 30)]
    return out


def hashed(texts):
    flat = [w for t in texts for w in t]
    own = {w: int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") for w in set(flat)}
    return np.array([own[w] for w in flat], np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_transform_is_exact_and_inverts():
    rng = np.random.default_rng(1)
    for n in (16, 32, 64, 128, 2048):
        a = rng.integers(0, pr.PRIME, (3, n)).astype(float)
        w = pow(pr.GENERATOR, (pr.PRIME - 1) // n, pr.PRIME)
        want = [sum(int(x) * pow(w, k * i, pr.PRIME) for i, x in enumerate(a[1])) % pr.PRIME for k in (0, 1, n // 2 + 1, n - 1)]
        got = pr.transform(a)
        assert got[1, [0, 1, n // 2 + 1, n - 1]].tolist() == want
        assert np.array_equal(pr._mod(pr.transform(got, True) * float(pow(n, -1, pr.PRIME))), a)


def test_runs_equal_plain_comparison():
    rng = random.Random(5)
    for _ in range(25):
        texts = [some_text(rng) for _ in range(12)]
        got = pr.find_runs(*hashed(texts)).tolist()
        assert [tuple(r) for r in got] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_long_periods_and_repeated_blocks():
    rng = random.Random(6)
    word = [str(rng.random()) for _ in range(3000)]
    texts = [["a"] * 30_000, word * 3 + word[:10], ["x", *word[:700]] * 4, word[:5] + ["a"] * 99 + ["b"], (["a"] * 99 + ["b"]) * 9]
    got = [tuple(r) for r in pr.find_runs(*hashed(texts)).tolist()]
    assert (0, 0, 30_000, 1) in got and (1, 0, 9010, 3000) in got and (2, 0, 2804, 701) in got and (3, 5, 99, 1) in got
    assert [r[1:] for r in got if r[0] == 4] == plain_runs(texts[4])


def test_periods_past_the_largest_block(monkeypatch):
    monkeypatch.setattr(pr, "LARGEST", 16)
    rng = random.Random(8)
    for _ in range(8):
        texts = [some_text(rng) for _ in range(8)]
        assert [tuple(r) for r in pr.find_runs(*hashed(texts)).tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_equal_hashes_of_unlike_stretches_are_found_out(monkeypatch):
    texts = [["a"] * 40 + ["b"] + ["a"] * 30]
    monkeypatch.setattr(pr, "Hashes", lambda w: type("H", (), {"of": lambda self, s, e: np.zeros(len(s))})())
    assert [tuple(r) for r in pr.find_runs(*hashed(texts)).tolist()] == [(0, 0, 40, 1), (0, 41, 30, 1)]


def expected(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), n))
    return sorted(out, key=str)


def test_report_equals_plain_version(spark):
    rng = random.Random(7)
    planted = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 10 == 0][:25]
    rows = [(d, " ".join(some_text(rng))) for d in [*range(25), *planted]]
    rows += [(planted[0], None), (planted[1], ""), (planted[2], " \n"), (planted[3], "one"), (None, "a " * 50), (7, "ä b  ö\x0b" * 20), (7, "ä b  ö\x0b" * 20), (8, None), (-3, "x\ty\r" * 30)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, runs string, h int").repartition(3)
    got = sorted((tuple(r) for r in pr.report(pr.planted(df)).collect()), key=str)
    assert got == expected(rows)
    assert pr.report(pr.planted(df.limit(0))).collect() == []


def test_query_on_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from loomfield.llm.queries import queries

    got = sorted((tuple(r) for r in queries()["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[1] for r in got) > 10
