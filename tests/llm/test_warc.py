import hashlib
import random

import numpy as np
import pytest

from loomfield.llm import warc

BIG = "<p>" + "é" * 200 + "</p>"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + "pad " * 40
ROWS = [(1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", FAKE), (8, "u", FAKE), (9, "u", "WARC/1.1\r\n" * 50), (2, "http://b/", BIG), (None, "u", BIG), (10, "u", "x" * 300_000), (11, "u", "\r\n\r\n" + "WARC/1.1\r\n\r\n" * 20), (-3, "u", BIG + " ")]


def expected(rows):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, h in payload:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, h in payload:
        again = len(h) >= 100 and h in first and (p is None or p > first[h])
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None, True))
    return sorted(out, key=lambda x: (x[0] is None, x))


def test_round_trip_with_magic_in_payloads(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=lambda x: (x[0] is None, x))
    assert got == expected(ROWS)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_stay_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 4)
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, k string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("part-*"))) == 4
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(ROWS)


def test_reachable_is_the_chain_from_the_start():
    rng = random.Random(2)
    for _ in range(50):
        at = np.array(sorted({0, *rng.sample(range(1, 400), 60)}))
        successor = np.array([rng.choice([*at[at > a].tolist(), 400, a + 1]) for a in at])
        want, here = set(), 0
        while here in at:
            want.add(here)
            here = int(successor[at.tolist().index(here)])
        assert set(at[warc.reachable(at, successor)].tolist()) == want
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]


def test_long_urls_do_not_end_a_chain(spark):
    rows = [(1, "u", "before"), (2, "http://h/" + "a" * 120_000, "long"), (3, "http://h/" + " " * 40_000, BIG), (4, "u", "behind"), (5, "u", "x: WARC/1.1\r\n" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(tuple(r) for r in warc.round_trip(pages).collect()) == expected(rows)


def test_headers_from_kept_lines_are_those_read_alone():
    rng = random.Random(4)
    parts = [b"WARC/1.1\r\n", b"a: ", b"Content-Length: 2\r\n", b"b: c\r\n", b"no colon", b"\r\n", b"\r\n\r\n", b"xy", b"\r\n\r\nxy\r\n\r\n"]
    for _ in range(300):
        data = b"".join(rng.choice(parts) for _ in range(40))
        kept, at = warc.Headers(data), data.find(warc.MAGIC)
        while at >= 0:
            head, want = data.find(b"\r\n\r\n", at + len(warc.MAGIC)), None
            if head >= 0:
                lines = [x.partition(b": ") for x in data[at + len(warc.MAGIC) : head].split(b"\r\n")]
                want = (head, {k.decode().lower(): v.decode() for k, _, v in lines}) if all(c for _, c, _ in lines) else None
            assert kept.at(at + len(warc.MAGIC)) == want
            at = data.find(warc.MAGIC, at + 1)


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000, raising=False)
    rows = [(i, "u", f"{i} " + "y" * 30_000) for i in range(20)] + [(100 + i, "u", f"short {i}") for i in range(30)] + [(200, "u", "z" * 150_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert sizes[-2] <= 100_000 and 150_000 < sizes[-1] < 152_000
    got = warc.read(spark, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_a_chain_that_misses_the_end_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    part = next((tmp_path / "w").glob("part-*")).read_bytes()
    for name, data in {"cut": part[:-3], "more": part + b"more", "none": b"no record"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="chain of records ends"):
            warc.read(spark, f"file://{tmp_path}/{name}").collect()
