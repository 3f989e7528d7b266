"""Operator 3: secret scans by a trigram inverted index, in DataFrame and SQL functions only.

Each rule is a regular expression. Its parse tree gives a Boolean trigram query: an OR of ANDs of trigrams, in lower
case, that every match must contain. The index is a table of postings (trigram, doc_id), written in order of trigrams, of the
trigrams that some rule asks for. The postings of the trigrams of each AND are read from it and intersected: a document is a
candidate if it stands in all of them. Only candidates are then searched with the rule. A rule changed within the indexed
trigrams reads postings again, not texts. Rules without mandatory trigrams (long hexadecimal strings) are searched in every
text.

Spans come from one chain of gaps and matches: the pattern ``\\G(.*?)(rule)`` starts where the last match ended, so the
running sums of the lengths of gaps and matches are offsets in code points, in one pass over the text. Running sums and
maxima are taken by doubling steps, n log n in the spans of a text.

Defined cases: a null text is empty; empty texts have no spans; rows are judged one by one, so repeated rows and ids stay,
and rows with a null id share their candidates, which the search then settles; other columns are not read, and the names of
helper columns give way to theirs. Texts are searched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import free_name, maybe_broadcast, written


@dataclass(frozen=True)
class Rule:
    """``pattern``: up to its last group; ``least``: code points that the match (or its last group, if ``value``) needs."""

    kind: str
    pattern: str
    least: int
    value: str = ""


#: The base rules, in the order in which kinds are listed, then the rules that this operator adds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 12, r"[A-Za-z0-9+/_.=-]+"),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("pay", r"sk_live_[A-Za-z0-9]{16,}", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
#: The kinds that the base digest covers.
BASE = ("assign", "access", "hex")


# --- Boolean trigram queries ------------------------------------------------------------------------------------------


def _strings(node, most: int = 16) -> set[str] | None:
    """All strings that a parse-tree node can match, in lower case, if they are few; else None."""
    kind, value = node
    if kind is rc.LITERAL:
        return {chr(value).lower()}
    if kind is rc.IN:
        chars = set()
        for k, v in value:
            if k is rc.LITERAL:
                chars.add(chr(v).lower())
            elif k is rc.RANGE and v[1] - v[0] < most:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= most else None
    if kind is rc.SUBPATTERN:
        return _sequence_strings(value[3], most)
    if kind is rc.BRANCH:
        parts = [_sequence_strings(x, most) for x in value[1]]
        return None if None in parts or sum(map(len, parts)) > most else set().union(*parts)
    if kind in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, body = value
        one = _sequence_strings(body, most)
        if one is None or high is rc.MAXREPEAT or high > 4 or len(one) ** high > most:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in product(sorted(one), repeat=n)}
    return None


def _sequence_strings(nodes, most: int) -> set[str] | None:
    found = {""}
    for node in nodes:
        own = _strings(node, most)
        if own is None or len(found) * len(own) > most:
            return None
        found = {a + b for a in found for b in own}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that each match of the pattern contains; empty if none is mandatory."""
    runs: list[set[str]] = [{""}]
    for node in rp.parse(pattern):
        own = _strings(node)
        if own is None or len(runs[-1]) * len(own) > 16:
            runs.append({""} if own is None else own)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in own}
    best: list[frozenset[str]] = []
    for run in runs:
        clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)]
        if clauses and all(clauses) and (not best or min(map(len, clauses)) > min(map(len, best))):
            best = sorted(set(clauses), key=sorted)
    return best


# --- the index and its candidates -------------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """The written index: postings (trigram, doc_id) of the trigrams that the rules ask for, one for each document that has the
    trigram. Files are in order of trigrams, so a look-up reads only the parts that hold its own."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])).cast("array<string>")
    return written(low.select(F.explode(has).alias("trigram"), "doc_id").sortWithinPartitions("trigram", "doc_id"), "secret-index")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): the rules that each document may match. The postings of the trigrams of each AND are intersected by
    counting: documents in as many of its lists as it has trigrams. Repeated ids have repeated postings, which count once."""
    clauses = [(n, r.kind, c) for n, (r, c) in enumerate((r, c) for r in rules for c in trigram_query(r.pattern))]
    asked = index.where(F.col("trigram").isin(sorted({t for _, _, c in clauses for t in c})))
    number = F.expr("array(" + ", ".join(f"if(array_contains(array({', '.join(_quoted(t) for t in sorted(c))}), trigram), struct({n} as clause, {len(c)} as needed), null)" for n, _, c in clauses) + ")")
    lists = asked.select("doc_id", "trigram", F.inline(F.array_compact(number)))
    both = lists.groupBy("doc_id", "clause", "needed").agg(F.count_distinct("trigram").alias("found")).where("found = needed")
    kinds = F.array(*[F.lit(k) for _, k, _ in clauses])
    return both.groupBy("doc_id").agg(F.collect_set(F.get(kinds, F.col("clause"))).alias("kinds"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- spans ------------------------------------------------------------------------------------------------------------


def _tight(rule: Rule) -> str:
    """The rule's pattern with its least length put in, where it ends in a run of one class: the run is maximal, and a
    shorter match cannot hold a longer one, so the matches are those of at least that length."""
    if rule.value or not rule.pattern.endswith("]+"):
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{rule.least - len(rule.pattern.split('[')[0])},}}"


def bound(value: Column, body) -> Column:
    """``body`` of a column that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join) -> Column:
    """Running results of an array under ``join``, a function of two columns (a sum, a maximum), by doubling: after k rounds
    each place covers the 2**k places that end with it."""
    back = lambda i, k: i - F.pow(F.lit(2), k).cast("int")
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(back(i, k) >= 0, join(x, F.get(acc, back(i, k)))).otherwise(x))
    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int"))
    return bound(values, lambda v: F.aggregate(rounds(v), v, step))


def _spans(text, rule: Rule):
    """Column: array of (start, end, kind number) of one rule in ``text``."""
    number = [r.kind for r in RULES].index(rule.kind)
    chain = rf"(?s)\G(.*?)({_tight(rule)})({rule.value})"
    parts = F.arrays_zip(*[F.transform(F.regexp_extract_all(text, F.lit(chain), F.lit(g)), F.length).alias(n) for g, n in ((1, "gap"), (2, "head"), (3, "tail"))])

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + x["head"] + x["tail"]), lambda x, y: x + y)
        return F.zip_with(p, ends, lambda x, e: F.struct((e - x["head"] - x["tail"]).alias("start"), e.alias("end"), F.lit(number).alias("kind"), (x["tail"] if rule.value else x["head"]).alias("size")))

    good = F.filter(bound(parts, placed), lambda x: x["size"] >= rule.least)
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan(docs: DataFrame, rules=RULES, found: str = "_found") -> DataFrame:
    """``docs`` with the column ``found``: all spans as (start, kind number, end), by start, then kind."""
    known_id, kinds = free_name(docs, "_known_id"), free_name(docs, "_kinds")
    known = maybe_broadcast(written(candidates(trigram_index(docs, rules), rules), "secret-candidates")).select(F.col("doc_id").alias(known_id), F.col("kinds").alias(kinds))
    joined = docs.join(known, docs["doc_id"].cast("long").eqNullSafe(known[known_id]), "left")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    parts = []
    for r in rules:
        # A search that fails costs one pass; the chain runs only where there is something to find.
        may = text.rlike(_tight(r))
        if trigram_query(r.pattern):
            may = F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)) & may
        parts.append(F.when(may, _spans(text, r)).otherwise(none))
    ordered = F.array_sort(F.transform(F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return joined.select(*[docs[c] for c in docs.columns if c != found], ordered.alias(found))


def _listed(spans, keep=None):
    names = F.array(*[F.lit(r.kind) for r in RULES])
    if keep is not None:
        spans = F.filter(spans, lambda x: x["kind"] < keep)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans, per row of ``docs``."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("_found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_listed(F.col("_found"), len(BASE)).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_found")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; overlapping spans become one, under the kind
    of the first. All rows stay, and texts without spans stay as they are; n_chars, if there, follows the new text."""
    names = F.array(*[F.lit(f"[{r.kind}]") for r in RULES])
    found, ends, new = (free_name(docs, x) for x in ("_found", "_ends", "_new"))
    spans, text = F.col(found), F.col("text").cast("string")
    # Where the text in front of each span ends: the largest end so far. Spans that start before it are within others.
    placed = F.zip_with(spans, F.concat(F.array(F.lit(0)), F.col(ends)), lambda x, at: F.struct(x.alias("x"), at.alias("at")))
    apart = F.filter(placed, lambda p: p["x"].isNotNull() & (p["x"]["start"] >= p["at"]))
    pieces = F.transform(apart, lambda p: F.concat(F.substring(text, p["at"] + 1, p["x"]["start"] - p["at"]), F.get(names, p["x"]["kind"])))
    cleaned = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    done = scan(docs, found=found).withColumn(ends, running(F.transform(spans, lambda x: x["end"]), F.greatest)).withColumn(new, F.when(F.size(spans) > 0, cleaned).otherwise(text))
    change = {"text": F.col(new), "n_chars": F.when(F.size(spans) > 0, F.length(new).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[change.get(c, F.col(c)).alias(c) for c in docs.columns])


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        chain = f"(?s)(.*?)({r.pattern})({r.value})".replace("'", "''")
        parts.append(f"select doc_id, text, {i} as k, '{r.kind}' as kind, {r.least} as least, {bool(r.value)} as valued, regexp_extract_all(text, '{chain}', 1) as g, regexp_extract_all(text, '{chain}', 2) as h, regexp_extract_all(text, '{chain}', 3) as v from d")
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as ({" union all ".join(parts)}),
x as (select doc_id, k, kind, least, valued, unnest(range(1, len(g) + 1)) as i, list_transform(g, lambda s: length(s)) as g, list_transform(h, lambda s: length(s)) as h, list_transform(v, lambda s: length(s)) as v from m),
y as (select doc_id, k, kind, list_sum(g[:i]) + coalesce(list_sum(h[:i-1]), 0) + coalesce(list_sum(v[:i-1]), 0) as s, h[i] + v[i] as n, case when valued then v[i] else h[i] end >= least as ok from x),
z as (select doc_id, k, kind, cast(s as bigint) as s, cast(s + n as bigint) as e from y where ok),
a as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where k < {len(BASE)}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from z group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join a using (doc_id)
"""


ORACLE_SQL = _oracle()
