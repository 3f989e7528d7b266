"""Operator 6: chat formatting in Spark expressions.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into a block with
array functions, and blocks are concatenated. The template's control strings are escaped inside texts and roles, so the
formatted string can be read back exactly: into turns, and into the characters under the loss mask.

Defined cases: turns are ordered by (turn, role, text), nulls first, so ties have one order; repeated rows are turns of
their own; null texts and roles are empty; rows with a null conv_id form one conversation; other columns are not read. A
conversation is one value of the output, so one task holds its turns, in time of n log(n) turns; nothing is collected across
conversations; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.secret_scan import bound, running


@dataclass(frozen=True)
class Template:
    """``open`` role ``head`` text (``again`` text)* ``close`` for each block of turns with one role. Only assistant texts
    are under the loss mask."""

    open: str = "<s>[INST:"
    head: str = "] "
    again: str = "<sep>"
    close: str = "</s>"
    loss_role: str = "assistant"
    #: What texts must not hold unescaped: this template's marks, and those of other common templates.
    controls: tuple[str, ...] = ("<s>", "</s>", "<sep>", "[INST:", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


ESCAPE = "\\"
DEFAULT = Template()


def escape(text: Column, controls: tuple[str, ...] = DEFAULT.controls) -> Column:
    """Double each escape character, then put one behind the first character of each control string. Control strings hold
    no escape character, so none is left whole, and every inserted one stands between two other characters."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: of two escape characters one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role_controls(t: Template) -> tuple[str, ...]:
    return (*t.controls, t.head)


def format_chats(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, and ``loss_spans``, the (start, end) of each assistant text in
    it, in code points, end exclusive."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("x"))
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or get(turns, i).role <> get(turns, i - 1).role)")
    blocks = F.expr("transform(starts, (s, k) -> struct(get(turns, s).role as role, transform(slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s), x -> x.text) as texts))")

    def pieces(b: Column) -> Column:
        """The strings of a block in order, and whether they are under the loss mask."""
        piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        no, loss = F.lit(False), b["role"] == t.loss_role
        head = piece(F.concat(F.lit(t.open), escape(b["role"], _role_controls(t)), F.lit(t.head)), no)
        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(t.again)), no), piece(escape(x, t.controls), loss))))
        return F.concat(F.array(head), body, F.array(piece(F.lit(t.close), no)))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["s"])), lambda x, y: x + y)
        return F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["s"])).alias("start"), e.alias("end"), x["loss"].alias("loss")))

    def written(p: Column) -> Column:
        spans = F.transform(F.filter(placed(p), lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))

    return (
        grouped.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .withColumn("done", bound(F.flatten(F.transform("blocks", pieces)), written))
        .select("conv_id", "done.formatted", "done.loss_spans")
    )


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns that a formatted string holds: array of (role, text)."""
    quoted = lambda s: f"\\Q{s}\\E"
    blocks = F.filter(F.split(formatted, quoted(t.open)), lambda b: b != "")
    body = lambda b: F.get(F.split(b, quoted(t.close)), 0)

    def turns(b: Column) -> Column:
        parts = F.split(body(b), quoted(t.head), 2)
        role = unescape(F.get(parts, 0))
        return F.transform(F.split(F.get(parts, 1), quoted(t.again)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def report(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """Digests of what is read back from the formatted strings."""
    done = format_chats(turns, t).withColumn("read", read_turns(F.col("formatted"), t))
    # Four bytes a code point, so a span is cut without counting from the start of the string.
    cut = lambda w, s: F.decode(F.substring(w, 4 * s["start"] + 1, 4 * (s["end"] - s["start"])), "UTF-32")
    loss = bound(F.struct(F.encode("formatted", "UTF-32").alias("wide"), "loss_spans"), lambda x: F.array_join(F.transform(x["loss_spans"], lambda s: unescape(cut(x["wide"], s))), ""))
    listed = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.withColumn("loss", loss).select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), digest(listed).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds, whose texts hold control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1."""
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))


def _sql_escape(column: str, controls: tuple[str, ...]) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in controls:
        out = f"replace({out}, '{c}', '{c[0] + ESCAPE + c[1:]}')"
    return out


def _oracle(t: Template = DEFAULT) -> str:
    extra = " union all ".join(f"select {c}, {n}, '{r}', '{x}'" for c, n, r, x in EXTRA)
    marks = len(t.open) + len(t.head) + len(t.close)
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all {extra}),
x as (select *, case when lag(role) over w is distinct from role then 1 else 0 end as new from c window w as (partition by conv_id order by turn, role, text)),
a as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as listed,
  coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{t.loss_role}'), '') as loss,
  sum(length({_sql_escape('text', t.controls)})) + sum(case when new = 1 then {marks} + length({_sql_escape('role', _role_controls(t))}) else {len(t.again)} end) as chars
  from x group by conv_id)
select conv_id, n_turns, sha256(listed) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from a
"""


ORACLE_SQL = _oracle()
