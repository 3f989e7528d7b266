import random
import struct

import pytest

from loomfield.llm import sentencepiece_codec as sc
from loomfield.llm.queries import MODEL_PATH


@pytest.fixture(scope="module")
def model():
    with open(MODEL_PATH, "rb") as f:
        return f.read()


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "  a  b ", "\n\n x\ty", "▁ ▁▁", "Grüße, 世界 🙂🙂", "aaaa" * 50, "=" * 999, "<s> </s> <0x0A> <unk>", "x" * 60_000, "word " * 30_000]
    out += ["".join(rng.choice("ab cde\n▁é世 .0") for _ in range(rng.randrange(200))) for _ in range(60)]
    return out


def test_ids_and_texts_equal_sentencepiece(spark, model):
    import sentencepiece

    truth = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in sc.decode(sc.encode(df, model), model).collect()}
    for i, t, _ in rows:
        want = truth.encode(t or "")
        assert got[i].ids == want
        assert got[i].decoded == truth.decode(want)


def test_round_trip_of_repeated_rows_and_empty_tables(spark, model):
    rows = [(1, "same text"), (1, "same text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens > 0, r.same_text) for r in sc.round_trip(df, model).collect())
    assert got == [(0, False, True), (1, True, True), (1, True, True)]
    assert sc.round_trip(df.limit(0), model).collect() == []


def test_decode_of_odd_lists(spark, model):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 413, None])], "n int, ids array<int>")
    assert {r.n: r.decoded for r in sc.decode(df, model).collect()}.keys() == {1, 2, 3}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(squeeze):
    """A small unigram model, written down piece by piece."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("a", -2.5, 1), ("b", -3.0, 1), ("ab", -3.1, 1), ("▁ab", -2.9, 1), ("c", -4.0, 1), ("bc", -4.2, 1), ("abc", -4.5, 1)]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    body += message((2, message((3, 1), (35, 1), (40, 0))))
    return body + message((3, message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_models_are_rebuilt(squeeze):
    import sentencepiece

    data = unigram_model(squeeze)
    truth = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = sc.Codec(data, 1)
    assert own.model.kind == sc.UNIGRAM and own.model.byte_fallback
    words = ["abc", "ab c", "  abcab  b", "", "aé", "cbabcabab"]
    rows, repaired = own.encode(words)
    assert [list(memoryview(r).cast("i")) for r in rows] == truth.encode(words)
    assert not any(repaired)  # the rebuilt pipeline gave them itself


def test_broken_models_are_refused():
    with pytest.raises(ValueError):
        sc.Codec(unigram_model(False).replace(b"identity", b"identity") + message((2, message((3, 4)))), 1)
