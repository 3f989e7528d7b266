import math
import random
import re
from collections import Counter

from loomfield.llm import quality_rules as qr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


TEXTS = [None, "", " \n\t", "one", "a b c d e " * 40, "x\ny\nx\n\n \nx", "🙂 é ü #*$%&|<> " * 3, "a\x0bb\x1cc\x0cd e f g h i j k l", "same line here\n" * 5, "w " * 9, "w " * 4 + "u v w x y z", " ".join(f"w{i}" for i in range(20_000)), "r s t u v q r s t u v " + " ".join(f"k{i}" for i in range(60))]


def test_counts_match_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", "x") for i, t in enumerate(TEXTS)] + [(0, "dup", "en", "x")], "doc_id long, text string, lang string, kept string").repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.judge(docs, labels).collect())
    assert got == sorted((i, *brute(t)) for i, t in [*enumerate(TEXTS), (0, "dup")])
    assert qr.judge(docs.limit(0), labels).collect() == []
    assert all(r.kept == (not r.base_failed) for r in qr.judge(docs, labels).collect())  # nothing can be certified


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_tail_is_the_binomial_one(spark):
    rows = [(k, n) for n in (1, 10, 300) for k in (0, 1, 7) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").selectExpr("k", "n", f"exp({qr._log_tail('k', 'n', 0.02)}) as t")
    for r in df.collect():
        assert abs(r.t - tail(r.k, r.n, 0.02)) < 1e-9


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(20)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"WORD{i}X{j}!!" for j in range(20)), "en") for i in range(50)]
    few = [(20_000 + i, " ".join(f"WORD{i}X{j}!!" for j in range(20)), "xx") for i in range(5)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in qr.keep(docs, labels).collect()}
    assert kept == {i for i, _, _ in good} | {i for i, _, _ in few}  # a stratum without labels rejects nothing


def moves_of(values, n_good, n_strata, risk=qr.Risk()):
    """Moves that are certified, from the features (by rule) of the good texts that the base rule keeps."""
    for at in range(1, len(qr.PATH) + 1):
        k = sum(any(v[r] > c for r, c in qr.PATH[:at]) for v in values)
        if not (k < n_good * risk.risk and tail(k, n_good, risk.risk) <= risk.delta / n_strata):
            return at - 1
    return len(qr.PATH)


def test_moves_are_those_of_the_exact_test_on_distinct_texts(spark):
    rng = random.Random(1)
    texts = {f"{'x' * 50} {'!' * rng.choice([0] * 200 + [9, 20, 60])} a b c d e f g h {i}" for i in range(900)}
    rows = [(i, t, "en") for i, t in enumerate(sorted(texts))]
    rows += [(5000 + i, t, "en") for i, t, _ in rows] + [(i, t, lang) for i, t, lang in rows[:30]]  # copies and repeated rows are no draws
    rows += [(9000 + i, f"one two three four five six seven eight nine ten {i}", None) for i in range(40)]
    feats = qr.features(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cache()
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows] + [(0, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.stratum: (r.n_good, r.moves) for r in qr.certified(feats, labels).collect()}
    values = [{r: (x.count("!") / (len(x) - x.count(" ")) if r == "bangs" else 0.0) for r in qr.RULES} for x in texts]
    want = moves_of(values, len(texts), 2)
    assert got == {"en": (len(texts), want), "": (40, 0)} and 0 < want < len(qr.PATH)


def test_false_rejections_stay_within_the_risk(spark):
    """Sixty strata whose good texts have too many symbols with known chances: after every certified move, fewer than the
    risk of them are rejected."""
    rng, rows, chance = random.Random(4), [], {}
    for s in range(60):
        chance[s] = rng.choice([0.0, 0.01, 0.018, 0.022, 0.03])
        for i in range(700):
            mark = "#" * 12 if rng.random() < chance[s] else "x" * 12
            rows.append((len(rows), f"{mark} aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii {s} {i}", f"s{s}"))
    feats = qr.features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = {int(r.stratum[1:]): r.moves for r in qr.certified(feats, labels).collect()}
    # The marks are over a fifth of these texts' characters, so the move to 0.2 rejects them.
    first = 1 + next(i for i, (r, c) in enumerate(qr.PATH) if r == "symbols" and c <= 0.2)
    assert all(chance[s] < qr.Risk.risk for s, m in got.items() if m >= first)
    assert all(got[s] == len(qr.PATH) for s in got if chance[s] == 0.0)
    assert all(m >= first - 1 for m in got.values())
