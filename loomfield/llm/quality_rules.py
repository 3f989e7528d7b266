"""Operator 5: quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Features of each text are computed in one narrow pass. Rules reject a document whose feature lies above a cutoff. ``PATH``
is a fixed list of moves, each of which lowers the cutoff of one rule, from rules that reject nothing; after each move stands
a policy, all cutoffs so far. Per stratum, labelled good texts (the holdout; nothing else is fitted on it) tell how many of
them each policy would reject beyond the base rule. A policy is certified if the exact binomial tail P(Bin(n, risk) <=
rejected) is at most ``delta`` over the number of strata, which is the one-sided Clopper-Pearson bound at that level lying
below ``risk``. Policies are tested in the order of the path and testing stops at the first that fails (fixed-sequence
testing, which needs no correction within a stratum; strata are corrected by Bonferroni); the last one certified is taken. So
the false rejections of all rules together stay below ``risk`` in every stratum at once with confidence 1 - ``delta``. With
four strata and the defaults that takes 217 good texts of which none is rejected.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum is the stratum ''; repeated rows
are judged and returned one by one; a label with null quality is no label, and of several labels of an id one good one
counts; equal texts of a stratum are one draw of the holdout, however many ids they stand under; other columns are not read,
so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import maybe_broadcast, written

#: The words of the base rules, and the symbols they count.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

#: Rules: name, and the feature that must not lie above the cutoff.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(word_chars, 1)",
}
#: The moves in order: rule and new cutoff. The rules whose high values are least likely in good text go first, and each has
#: a floor that no certificate lowers it beyond.
PATH = (
    *(("symbols", c) for c in (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02)),
    *(("bangs", c) for c in (0.5, 0.3, 0.2, 0.1, 0.05)),
    *(("capitals", c) for c in (0.9, 0.7, 0.5, 0.4, 0.3)),
    *(("dup_lines", c) for c in (0.9, 0.7, 0.5, 0.4, 0.3)),
    *(("repeats", c) for c in (0.9, 0.5, 0.2, 0.18, 0.16)),
)


@dataclass(frozen=True)
class Risk:
    """``risk``: share of good texts of a stratum that all rules together may reject; ``delta``: the chance that this is exceeded
    in any stratum."""

    risk: float = 0.02
    delta: float = 0.05


def features(docs: DataFrame, stratum: str = "lang", whole: bool = False) -> DataFrame:
    """doc_id, stratum, a hash of the text and the counts that the rules need, per row of ``docs``, and with ``whole`` the row
    itself as the struct ``_row``. One narrow pass, no shuffle."""
    row = [F.struct(*docs.columns).alias("_row")] if whole else []
    words = (
        docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("w", F.array_remove(F.split("text", SEPARATORS), ""))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SEPARATOR_CHARS, "")) > 0))
    )
    hashed = words.withColumn(
        "h", F.expr("if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4))))")
    ).withColumn("repeats", F.expr("size(array_distinct(h)) < size(h)"))
    ordered = hashed.withColumn("s", F.expr("if(repeats, array_sort(transform(h, (x, i) -> struct(x as x, i as i))), null)"))
    again = ordered.withColumn("d", F.expr("array_sort(transform(filter(s, (e, k) -> (k > 0 and get(s, k - 1).x = e.x) or get(s, k + 1).x = e.x), e -> e.i))"))
    covered = F.expr("aggregate(transform(d, (p, k) -> least(5, coalesce(get(d, k + 1), p + 5) - p)), 0L, (a, x) -> a + x)")
    taken = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return again.select(
        *["_row"][: len(row)],
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SEPARATOR_CHARS, "")).cast("long").alias("word_chars"),
        taken(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        taken("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        taken("!").alias("n_bangs"),
    )


def _log_tail(k: str, n: str, p: float) -> str:
    """SQL for ln P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds, none = f"ln({p!r}) - ln(1 - {p!r})", f"{n} * ln(1 - {p!r})"
    step = f"a.t + ln(({n} - i + 1) / i) + {odds}"
    return (
        f"if({k} = 0, {none}, aggregate(sequence(1L, {k}), struct({none} as t, {none} as s), (a, i) -> "
        f"struct({step} as t, greatest(a.s, {step}) + log1p(exp(-abs(a.s - ({step})))) as s), a -> a.s))"
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def first_move(rule: str) -> Column:
    """The first move after which the rule rejects a document with these features; null if none does."""
    value, out = F.expr(f"cast({RULES[rule]} as double)"), F
    for at, (name, cutoff) in enumerate(PATH, 1):
        if name == rule:
            out = out.when(value > cutoff, at)
    return F.lit(None).cast("int") if out is F else out


def certified(feats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, n_good, moves): how many good texts a stratum has, and how many moves of ``PATH`` are certified there (0: the
    rules reject nothing). Strata without good texts have no row."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    at = F.when(base_failed(), None).otherwise(F.least(*[first_move(r) for r in RULES]))
    texts = feats.withColumn("at", at).select("doc_id", "stratum", "text_hash", "at").join(good, "doc_id").groupBy("stratum", "text_hash").agg(F.min("at").alias("at"))
    # One row per stratum: how many good texts are first rejected by each move.
    bins = texts.groupBy("stratum", "at").agg(F.count("*").alias("n"))
    strata = bins.groupBy("stratum").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("at", "n")).alias("bins"))
    tested = strata.withColumn("n_strata", F.count("*").over(_all())).select("stratum", "n_good", "n_strata", "bins", F.explode(F.sequence(F.lit(1), F.lit(len(PATH)))).alias("move"))
    tested = tested.withColumn("rejected", F.expr("aggregate(filter(bins, b -> b.at <= move), 0L, (a, b) -> a + b.n)"))
    passes = (F.col("rejected") < F.col("n_good") * risk.risk) & (F.expr(_log_tail("rejected", "n_good", risk.risk)) <= F.log(F.lit(risk.delta) / F.col("n_strata")))
    stop = F.coalesce(F.min(F.when(~F.coalesce(passes, F.lit(False)), F.col("move"))), F.lit(len(PATH) + 1))
    return tested.groupBy("stratum", "n_good").agg((stop - 1).alias("moves"))


def _all():
    """All strata (a small table by then) in one window, to count them."""
    from pyspark.sql import Window

    return Window.partitionBy()


def judged(docs: DataFrame, labels: DataFrame, risk: Risk, stratum: str, whole: bool = False) -> DataFrame:
    """The features with base_failed, the failed rules and kept."""
    feats = written(features(docs, stratum, whole), "quality-features")
    # At most one row per stratum with enough labels to certify anything (hundreds of texts each): far fewer rows than
    # labels; its size is checked all the same before it is broadcast.
    moves = written(certified(feats, labels, risk).where("moves > 0").select("stratum", "moves"), "quality-cutoffs")
    failed = F.array_compact(F.array(*[F.when(first_move(r) <= F.col("moves"), F.lit(r)) for r in RULES]))
    joined = feats.join(maybe_broadcast(moves), "stratum", "left").withColumn("failed_rules", F.array_join(failed, ",")).withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """Counts and verdict per row of ``docs``: base_failed, kept, and the names of the rules that reject it."""
    return judged(docs, labels, risk, stratum).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def keep(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judged(docs, labels, risk, stratum, whole=True).where("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


_VALUES = ", ".join(f"({at}, '{r}', {c!r})" for at, (r, c) in enumerate(PATH, 1))
_FEATURE_SQL = " union all ".join(f"select stratum, doc_id, text, base_failed, '{r}' as rule, cast({e} as double) as value from f" for r, e in RULES.items())

ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select doc_id, stratum, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
keyed as (select doc_id, i, w[i:i+4] as k from win),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from keyed) where c > 1),
rep as (select doc_id, count(distinct i + j) as n from twice, (select unnest(range(0, 5)) as j) group by doc_id),
c as (select w.doc_id, stratum, text, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  coalesce(rep.n, 0) as n_repeat_words, cast(len(lines) as bigint) as n_lines, cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
  cast(length(regexp_replace(text, '[^!]', '', 'g')) as bigint) as n_bangs from w left join rep using (doc_id)),
f as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from c),
v as ({_FEATURE_SQL}),
path(move, rule, cutoff) as (values {_VALUES}),
good as (select stratum, text, base_failed, rule, value from v join (select doc_id from labels group by doc_id having max(quality) = 1) using (doc_id)),
size as (select stratum, count(distinct text) as n, count(*) over () as m from good group by stratum),
hit as (select distinct stratum, text, move from good join path using (rule) where value > cutoff and not base_failed),
first as (select stratum, text, min(move) as move from hit group by all),
test as (select s.stratum, p.move, n, m, (select count(*) from first where first.stratum = s.stratum and first.move <= p.move) as k from size s, path p),
tail as (select *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({Risk.risk!r}) + (n - i) * ln(1 - {Risk.risk!r})))) as p from test),
stop as (select stratum, coalesce(min(move) filter (where not (k < n * {Risk.risk!r} and p <= {Risk.delta!r} / m)), {len(PATH) + 1}) - 1 as moves from tail group by stratum),
bad as (select doc_id, string_agg(distinct rule, ',' order by list_position({list(RULES)!r}, rule)) as failed_rules from v join path using (rule) join stop using (stratum) where value > cutoff and move <= moves group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and failed_rules is null) as kept, coalesce(failed_rules, '') as failed_rules from f left join bad using (doc_id)
"""
