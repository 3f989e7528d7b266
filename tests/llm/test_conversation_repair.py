import functools
import hashlib
import random
import re
import zlib

import pytest

from loomfield.llm import conversation_repair as cr


def plain_align(letters, must_go, more):
    """Whole tables against every target of up to twice the turns and two, with audits as values."""
    n, found = len(letters), []
    for m in [0, *range(2, 2 * n + 4)]:
        target = "s" * (m % 2) + "ua" * (m // 2)

        @functools.cache
        def f(i, j, target=target):
            options = [(0, "")] if i == n and j == len(target) else []
            if i < n:
                c, a = f(i + 1, j)
                options.append((c + 4, "D" + a))
            if j < len(target) and target[j] != "s":
                c, a = f(i, j + 1)
                options.append((c + 3, "I" + a))
            if i < n and j < len(target) and not must_go[i]:
                c, a = f(i + 1, j + 1)
                if letters[i] == target[j]:
                    options.append((c + more[i], "K" + a))
                elif target[j] != "s":
                    options.append((c + 3 + more[i], "R" + a))
            return min(options, default=(10**9, ""))

        found.append(f(0, 0))
    return min(found)


def case(rng, n):
    kind = rng.randrange(3)
    letters = "".join(rng.choice(["uua", "suax", "ua"][kind]) if rng.random() < 0.4 else "ua"[i % 2] for i in range(n))
    must_go = [rng.random() < 0.15 for _ in range(n)]
    return letters, must_go, [3 * (not g and rng.random() < 0.25) for g in must_go]


@pytest.mark.parametrize("segment", [1, 2, 3, 512])
def test_align_equals_whole_tables(segment):
    rng = random.Random(segment)
    for _ in range(500):
        x = case(rng, rng.randrange(1, 11))
        assert cr.align(*x, segment=segment) == plain_align(*x), x


def test_segments_give_what_one_table_gives():
    rng = random.Random(9)
    for _ in range(15):
        x = case(rng, rng.randrange(60, 150))
        assert cr.align(*x, segment=16) == cr.align(*x) == cr.align(*x, segment=61)


def test_long_conversations_take_linear_time():
    rng = random.Random(10)
    x = case(rng, 6000)
    cost, audit = cr.align(*x)
    assert cost < 4 * 6000 and len(audit) - audit.count("I") == 6000


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = by.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        own += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = "".join(r[:1] or "?" for _, r, _ in own)
        cost, audit = plain_align(initials, [f in ("blank", "duplicate") for f in faults], [3 * (f == "truncated") for f in faults]) if own else (0, "")
        m = sum(e != "D" for e in audit)
        target, i, done = iter(["system"] * (m % 2) + ["user", "assistant"] * (m // 2)), 0, []
        for e in audit:
            if e != "D":
                role = next(target)
                done.append(f"{own[i][1] if e == 'K' else role}:{'' if e == 'I' else own[i][2]}")
            i += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def test_report_equals_plain_version(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(300), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else rng.choice(["system", "tool", "", None]) if rng.random() < 0.1 else ["user", "assistant"][turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), role, rng.choice(["Same. ", f"Text {turn}!", "ends\n", "", None, " \t", "é?\x0b", f"A: b.\nc {turn}."])))
    rows += [(1000, 0, "user", "x."), (1000, 0, "user", "x."), (1001, None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, h int").repartition(5)
    assert sorted((tuple(r) for r in cr.report(df).collect()), key=str) == expected(rows)
    assert cr.report(df.limit(0)).collect() == []


def test_query_on_the_small_tables(spark):
    from loomfield.llm.queries import queries

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op13_conversation_repair"](spark, folder).collect()), key=str)
    assert got == expected(rows)
    assert len(got) == len({r[0] for r in rows}) and any("I" in r[7] for r in got) and any("D" in r[7] for r in got)
