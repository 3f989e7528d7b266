import hashlib
import time

from loomfield.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 1, "user", "hi </s>[INST] \\ <s>"), (1, 0, "system", "\\\\ <\\s>"), (1, 2, "assistant", "<sep>a</s>"), (1, 3, "assistant", "again <s>[INST:x] "), (1, 4, "user", None), (1, 5, "user", ""),
    (2, 0, "assistant", "only\n🙂"), (2, 0, "assistant", "only\n🙂"), (3, None, None, None), (3, 1, "] <s>", "odd role"), (None, 1, "user", "no id"), (None, 0, "assistant", "first"), (4, 0, "user", "<" * 5 + "s>" + "</s" + ">"), (4, 1, "assistant", "x" * 100_000 + "<<SYS>>"),
]


def expected(rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c, _, role, text, *_ in order:
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    done = {}
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        done[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return done


def test_turns_and_loss_read_back(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(4)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.report(df).collect()}
    assert got == expected(ROWS)
    assert cf.report(df.limit(0)).collect() == []


def test_adjacent_turns_share_a_block_and_controls_are_escaped(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)
    by = {r.conv_id: r.formatted for r in cf.format_chats(df).collect()}
    t = cf.DEFAULT
    assert by[1].count(t.open) == 4 and by[1].count(t.close) == 4 and by[1].count(t.again) == 2
    assert by[2] == f"{t.open}assistant{t.head}only\n🙂{t.again}only\n🙂{t.close}"


def test_extra_conversation(spark):
    df = cf.with_extra(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in cf.report(df).collect()}
    assert got[-1] == (2, len("</s>[INST] ok [/INST]"))


def test_many_turns_take_time_in_proportion(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} é <s> " + "w " * 20) for i in range(16_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    began = time.time()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.report(df).collect()}
    assert got == expected(rows) and time.time() - began < 15
