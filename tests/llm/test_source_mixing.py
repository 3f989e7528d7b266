import random

import numpy as np
import pytest

from loomfield.llm import source_mixing as sm


def corpus(spark, n=1200):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 0, 0, 1, 2])
        w = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        if kind == 2:
            for _ in range(len(w) // 8):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "clown", "moron"])
        rows.append((i, " ".join(w), "s", "x"))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(None, None, None, "x"), (5000, "", "s", "x"), (5000, "", "s", "x")]
    labels += [(None, 1, 1), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tables(spark):
    return corpus(spark)


def expected_tokens(rows):
    return {d: sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in sm.DOMAINS}, {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in sm.DOMAINS}


def test_targets_are_met_and_domains_found(spark, tables):
    docs, labels = tables
    mix = sm.Mix(factors={"clean": 1.0, "low": 0.5, "toxic": 0.4})
    rows = sm.report(docs.drop("rate"), labels, mix).collect()
    assert len(rows) == docs.count()
    natural, got = expected_tokens(rows)
    for d in sm.DOMAINS:
        assert abs(got[d] - mix.factors[d] * natural[d]) < 2e-3 * natural[d]
    assert min(r.rate for r in rows) >= 0
    held = {r.doc_id: r for r in rows}
    right = [max(sm.DOMAINS, key=lambda d, r=held[x.doc_id]: r[f"p_{d}"]) == ("toxic" if x.toxic else "low" if not x.quality else "clean") for x in labels.where("doc_id is not null and quality is not null").collect()]
    assert np.mean(right) > 0.9
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (None, 5000))


def test_sampling_keeps_columns_and_rates(spark, tables):
    docs, labels = tables
    mix = sm.Mix(factors={"clean": 1.0, "low": 0.0, "toxic": 0.0}, max_rate=1.0)
    out = sm.sample(docs, labels, mix)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len({r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 5000}) == sum(r.doc_id is not None and r.doc_id < 5000 for r in kept)
    assert sum("!!" in (r.text or "") for r in kept) < 0.1 * docs.where("text like '%!!%'").count()


def test_no_labels_and_no_rows(spark, tables):
    docs, labels = tables
    assert sm.report(docs.limit(0).drop("rate"), labels).collect() == []
    assert sm.report(docs.limit(20).drop("rate"), labels.limit(0)).count() == 20


def test_rates_project():
    p = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    assert sm.rates_after(p, np.array([[-5.0, 2.0, 0]]), 3.0).tolist() == [3.0, 0.0]


def dense(tokens, p, want, scale, most, rounds=60_000):
    """The nearest totals that rates from 0 to ``most`` can give: plain projected gradients over all rates at once."""
    r = np.ones(len(tokens))
    a = p * tokens[:, None] / scale
    b, length = want / scale, 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        r = np.clip(r - length * (a @ (r @ a - b)), 0, most)
    return (r @ a) * scale


@pytest.mark.parametrize("factors", [(1.0, 0.5, 0.25), (1.3, 2.0, 0.1), (1.0, 0.0, 9.0), (5.0, 5.0, 0.0)])
def test_totals_are_those_of_a_dense_solver(factors):
    """Targets within reach are met; beyond it the totals are the nearest ones."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.2, 0.2], 400)
    t = rng.integers(10, 300, 400).astype(float)
    natural, k = t @ p, len(sm.DOMAINS)
    want, mix = natural * np.array(factors), sm.Mix(most_steps=4000, max_rate=4.0)

    def totals(steps, rated):
        r = sm.rates_after(p, steps, mix.max_rate)
        pull = p @ steps[-1] if len(steps) else np.zeros(len(p))
        free = t * ((r > 0) & (r < mix.max_rate) | (r > 0) & (pull > 0) | (r <= 0) & (pull < 0)) if len(steps) else t
        return (t * r) @ p, (p * free[:, None]).T @ p

    steps, got = sm.descend(totals, natural, want, mix)
    scale = sm.scale_of(natural, want)
    true = dense(t, p, want, scale, mix.max_rate)
    assert steps.shape[1] == k
    assert np.abs(got - true).max() < 5e-3 * scale.max() or (np.abs(got - want) <= mix.tolerance * scale).all()
    assert ((got - want) ** 2 / scale**2).sum() <= ((true - want) ** 2 / scale**2).sum() * 1.02 + 1e-6


def test_weights_are_shares_of_the_tokens(spark, tables):
    docs, labels = tables
    mix = sm.Mix(weights={"clean": 8, "low": 1, "toxic": 1}, total=20_000)
    fitted, scored = sm.fit(docs.drop("rate"), labels, mix)
    rows = {r.domain: r for r in sm.summary(spark, fitted).collect()}
    assert all(r.met for r in rows.values()) and [rows[d].target for d in sm.DOMAINS] == [16_000, 2_000, 2_000]
    _, got = expected_tokens(sm.rate(scored, fitted).collect())
    for d in sm.DOMAINS:
        assert abs(got[d] - rows[d].target) < 2e-3 * rows[d].target + 5


def test_out_of_reach_is_reported(spark, tables):
    docs, labels = tables
    with pytest.warns(UserWarning, match="not met"):
        fitted, _ = sm.fit(docs.drop("rate"), labels, sm.Mix(factors={"low": 9.0}, max_rate=2.0))
    assert not fitted.met and fitted.got[1] < fitted.want[1]


def test_clashing_and_repeated_names_and_ids(spark, tables):
    docs, labels = tables
    clash = docs.selectExpr("doc_id", "text", "rate as _z", "rate as _tokens", "rate as copies")
    rated = sm.report(clash, labels).collect()
    assert len(rated) == docs.count() and rated[0].__fields__ == ["doc_id", "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"]
    assert sm.sample(clash, labels).columns == clash.columns
    # An id on many rows is one row of the calibration, the same however rows are dealt.
    many = docs.drop("rate").unionByName(docs.drop("rate").where("doc_id = 7").crossJoin(spark.range(300)).drop("id"))
    a, b = (sm.fit(x, labels)[0] for x in (many, many.repartition(7)))
    assert np.allclose(a.slopes, b.slopes, rtol=1e-9) and np.allclose(a.steps, b.steps, rtol=1e-6)
