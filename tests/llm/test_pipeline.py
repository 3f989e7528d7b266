import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_jaccard_join import shingle_set  # noqa: E402
from test_quality_rules import brute as quality  # noqa: E402
from test_secret_scan import brute as secrets  # noqa: E402

from loomfield.llm import secret_scan  # noqa: E402
from loomfield.llm.queries import MODEL_PATH  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(9), tmp_path_factory.mktemp("tables")
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 90)))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300 + i, rows[20 + i][1] + " tail") for i in range(10)]
    rows += [(400, "password=abcdefghijklmnop " + rows[50][1]), (401, None), (402, ""), (403, "a b c d e " * 30), (404, "x" * 5000)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict(rows)


def test_stages_against_plain_versions(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, expected = docs.columns, dict(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "secret scan", "source mixing", "SentencePiece encoding"]

    docs = stages["quality rules"](spark, docs, path).cache()
    expected = {i: t for i, t in expected.items() if not quality(t)[-1]}  # too few labels to certify more
    assert {r.doc_id: r.text for r in docs.collect()} == expected and docs.columns == columns

    docs = stages["n-gram Jaccard join"](spark, docs, path).cache()
    sets, kept = {i: shingle_set(t) for i, t in expected.items()}, {}
    group = {i: i for i in expected}
    for _ in expected:
        new = {i: min([group[i]] + [group[j] for j in expected if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]) for i in expected}
        if new == group:
            break
        group = new
    kept = {i: t for i, t in expected.items() if group[i] == i}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and docs.columns == columns

    docs = stages["secret scan"](spark, docs, path).cache()
    for r in docs.collect():
        want, at = "", 0
        for s, k, e in secrets(kept[r.doc_id]):
            if s >= at:
                want += kept[r.doc_id][at:s] + f"[{secret_scan.RULES[k].kind}]"
            at = max(at, e)
        assert r.text == want + kept[r.doc_id][at:]
    assert docs.columns == columns

    before = {r.doc_id for r in docs.collect()}
    docs = stages["source mixing"](spark, docs, path).cache()
    ids = [r.doc_id for r in docs.collect()]
    assert docs.columns == columns and set(ids) <= before and len(ids) == len(set(ids))
    assert len(ids) > 0.9 * len(before)  # all labels are clean

    import sentencepiece

    truth = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    done = stages["SentencePiece encoding"](spark, docs, path).collect()
    assert {r.doc_id: r.ids for r in done} == {i: truth.encode(t) for i, t in texts.items()}


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 80


def write_tables(spark, path, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, k string, _found string, bucket int, rate string, ids string"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), "r", "k", "f", 1, "x", "y") for i, t, g in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_with_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en"), (1, a, "en"), (None, a, None), (None, b, "en"), (2, b, None), (3, c, "en"), (3, text(), "en"), (4, None, "en"), (5, "", None), (6, "short", "en"), (None, None, None), (7, "x" * 100_000 + " " + text(), "en")]
    path = write_tables(spark, tmp_path, rows, [(1, 1, 0), (None, 1, 0), (2, None, None), (9, 1, 1)])
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
        if n == 2:  # too short ones fail the base rule; rows without an id all stay, and both texts under id 3
            kept = ids(docs)
            assert kept == [(False, 1), (False, 2), (False, 3), (False, 3), (False, 7), (True, 0), (True, 0)]
    out = ids(corpus_pipeline.run(spark, path))
    assert out == ids(docs) and set(out) <= set(kept)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, tmp_path, [], [])).collect() == []
