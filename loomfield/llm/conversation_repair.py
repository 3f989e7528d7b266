"""Operator 13: conversations repaired to alternating turns by the cheapest edits, with an audit of each edit.

The role initials of a repaired conversation are those of ``(s?(ua)+)?``: an optional system turn, then pairs of user and
assistant; or nothing. There is one such string for each feasible length, so the turns are aligned to each length by the
Wagner-Fischer recurrence: keep (0), rerole to user or assistant (3), delete (4), insert an empty turn (3). All lengths end
alike, so one table from the last turn backwards serves them all: its column j is the alignment to the last j letters.
Ukkonen's band leaves out cells whose surplus or lack of letters alone costs more than an incumbent, which a greedy repair with a
look ahead at the next turn gives for every suffix. Blank turns and duplicates must go; a truncated turn that stays costs 3
more. Of the lengths that reach the least cost, each is traced back, taking the least letter wherever several lead on, and
the audits are compared; the least string wins (D before I before K before R).

Conversations of more than ``SEGMENT`` turns are aligned segment by segment from the end, to the lengths of each segment's part
for both letters that may be due at its ends, so work grows with the turns rather than with their square.

Defined cases: rows are ordered by (turn, role, text), nulls first; repeated rows are duplicates; a null role or text is one
space, so a null text is blank, and a null role has no letter of the grammar; rows with a null conv_id form one
conversation; other columns are not read; an empty table gives no rows. One task holds the turns of one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import crc32_sql

#: What edits cost, and what is added to a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that one table covers.
SEGMENT = 512
#: Characters of repaired texts that leave a task in one batch, about.
BATCH = 4 << 20
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}

_WORD = re.compile(r"[^\x20\x09-\x0D]")


def fault(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """The first fault of a turn, or nothing."""
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    if not last:
        return "blank"
    return "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"


class Table:
    """Least costs of turns p to q against j letters that end before ``due``: the letter that the turns behind q begin with."""

    def __init__(self, letters: str, must_go: list[bool], more: list[int], p: int, q: int, due: str, bands: list[tuple[int, int]]):
        self.letters, self.must_go, self.more, self.p, self.q, self.due, self.bands = letters, must_go, more, p, q, due, bands
        last = OTHER[due]
        #: The first of j letters.
        self.first = lambda j: last if j % 2 else due
        low, high = bands[q]
        self.rows: list[list[int]] = [[]] * (q - p) + [[INSERT * j for j in range(low, high + 1)]]
        for i in range(q - 1, p - 1, -1):
            low, high = bands[i]
            below, under, row = self.rows[i + 1 - p], bands[i + 1][0], []
            size, letter, stays, left = len(below), letters[i], not must_go[i], NEVER
            for j in range(low, high + 1):
                k = j - under
                best = below[k] + DELETE if 0 <= k < size else NEVER
                if left + INSERT < best:
                    best = left + INSERT
                if stays and 0 < k <= size:
                    kept = below[k - 1] + more[i] + (0 if letter == (last if j % 2 else due) else REROLE)
                    if kept < best:
                        best = kept
                row.append(best)
                left = best
            self.rows[i - p] = row

    def cost(self, i: int, j: int) -> int:
        low, high = self.bands[i]
        return self.rows[i - self.p][j - low] if low <= j <= high else NEVER

    def audit(self, i: int, j: int) -> str:
        """The least string of edits that reaches the cost of (i, j)."""
        out = []
        while i < self.q or j:
            now = self.cost(i, j)
            if i < self.q and self.cost(i + 1, j) + DELETE == now:
                out.append("D")
                i += 1
            elif j and self.cost(i, j - 1) + INSERT == now:
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.letters[i] == self.first(j) else "R")
                i, j = i + 1, j - 1
        return "".join(out)


def _greedy(letters: str, must_go: list[bool], more: list[int], p: int, q: int) -> list[int]:
    """For each turn from p to q the cost of some repair of the turns from it to q, whatever letters are due at both ends."""
    cost, after, out = {"u": 0, "a": 0}, "", [6] * (q - p + 1)
    for i in range(q - 1, p - 1, -1):
        if must_go[i]:
            cost = {z: c + DELETE for z, c in cost.items()}
        else:
            now = {}
            for z, other in OTHER.items():
                if letters[i] == z:
                    now[z] = cost[other]
                elif letters[i] == other and after == z:  # the letter due is missing here: what follows is in step again
                    now[z] = INSERT + cost[z]
                else:
                    now[z] = REROLE + cost[other]
            cost, after = {z: c + more[i] for z, c in now.items()}, letters[i]
        out[i - p] = max(cost.values()) + 2 * INSERT
    return out


def _bands(letters: str, must_go: list[bool], more: list[int], p: int, q: int) -> dict[int, tuple[int, int]]:
    """For each turn, the numbers of letters that a repair no dearer than the incumbent can give the turns from it on."""
    out, stay, base, soft = {}, 0, 0, 0
    greedy = _greedy(letters, must_go, more, p, q)
    for i in range(q, p - 1, -1):
        if i < q:
            stay, base, soft = stay + (not must_go[i]), base + (DELETE if must_go[i] else more[i]), soft + (not must_go[i] and more[i] > 0)
        spare = greedy[i - p] - base
        # Each letter too many is an insertion; each too few a deletion, which spares a truncated turn's surcharge.
        cheap = min(soft, spare // (DELETE - TRUNCATED))
        out[i] = (max(0, stay - cheap - (spare - cheap * (DELETE - TRUNCATED)) // DELETE), stay + spare // INSERT)
    return out


def align(letters: str, must_go: list[bool], more: list[int], segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns with these role initials (one character each)."""
    n = len(letters)
    #: Best repair of the turns behind a segment: with this letter due; ``some``: user is due and one letter comes at least.
    tail: dict[str, tuple[int, str]] = {"u": (0, ""), "a": (NEVER, ""), "some": (NEVER, "")}
    with_system = (NEVER, "")
    incumbent = None
    for q in range(n, 0, -segment):
        p = max(0, q - segment)
        bands = _bands(letters, must_go, more, p, q)
        tables = [Table(letters, must_go, more, p, q, due, bands) for due in "ua" if tail[due][0] < NEVER or (due == "u" and tail["some"][0] < NEVER)]

        def best(i: int, due: str, some: bool, limit: int, tables=tables, tail=tail, bands=bands) -> tuple[int, str]:
            """Of all lengths that begin with ``due`` and reach the least cost (up to ``limit``), the least audit."""
            found, least = [], limit
            for t in tables:
                for j in range(bands[i][0], bands[i][1] + 1):
                    if (t.first(j) if j else t.due) == due:
                        rest = tail["some" if some and not j else t.due]
                        cost = t.cost(i, j) + rest[0]
                        if cost <= least and cost < NEVER:
                            found = found if cost == least else []
                            found.append((t, j, rest[1]))
                            least = cost
            return min(((least, t.audit(i, j) + rest) for t, j, rest in found), default=(NEVER, ""))

        incumbent = incumbent or DELETE * n
        for i in range(p, min(q, incumbent // DELETE + 1)):
            if letters[i] == "s" and not must_go[i]:
                spent = DELETE * i + more[i]
                cost, audit = best(i + 1, "u", True, min(incumbent, with_system[0]) - spent) if i + 1 < q else tail["some"]
                with_system = min(with_system, (cost + spent, "D" * i + "K" + audit))
        tail = {"u": best(p, "u", False, NEVER), "a": best(p, "a", False, NEVER), "some": best(p, "u", True, NEVER)}
    return min(tail["u"], with_system)


def apply_audit(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired turns; the target's letters follow from the number of edits that leave a turn."""
    out, i = [], 0
    length = len(audit) - audit.count("D")
    for edit in audit:
        role = NAMES["a" if (length - len(out)) % 2 else "u"]
        if edit != "D":
            out.append((role, "") if edit == "I" else (turns[i][0] if edit == "K" else role, turns[i][1]))
        i += edit != "I"
    return out


def repair_one(turns: list[tuple[int | None, str, str]]) -> dict:
    """Faults, cost, audit and repaired turns of one conversation, whose (turn, role, text) are in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in turns:
        faults.append(fault(role, text, seen))
        seen.add((role, text))
    letters = "".join(role[:1] or "-" for _, role, _ in turns)
    numbers = {t for t, _, _ in turns if t is not None}
    cost, audit = align(letters, [f in ("blank", "duplicate") for f in faults], [TRUNCATED if f == "truncated" else 0 for f in faults])
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(letters[i : i + 2] not in LEGAL for i in range(len(letters) - 1)), "cost": cost, "audit": audit,
        "repaired": [{"role": r, "text": x} for r, x in apply_audit([(r, x) for _, r, x in turns], audit)],
    }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired array<struct<role:string,text:string>>"


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: numbers of faults, cost, audit, and the repaired turns."""

    def conversations(batches) -> Iterator[tuple[int | None, list]]:
        known, rows = False, []
        own = None
        for batch in batches:
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known and conv != own:
                    yield own, rows
                    rows = []
                known, own = True, conv
                rows.append(tuple(turn))
        if known:
            yield own, rows

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        names = ["conv_id", *COUNTS, "audit", "repaired"]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        held, size = [], 0
        for conv, rows in conversations(batches):
            held.append({"conv_id": conv} | repair_one(rows))
            size += sum(len(r[2]) + 50 for r in rows)
            if size > BATCH:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, SCHEMA)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows that the query repairs: by a checksum of conversation and turn, some are dropped, emptied, left without their
    stops, repeated, or given to the user."""
    x = turns.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    h = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    x = x.withColumn("h", h).where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return x.drop("copy")


def report(turns: DataFrame) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired turns of every conversation, after the damage."""
    listed = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    done = repair(damaged(turns)).select(F.col("conv_id").alias("own"), *COUNTS, "audit", F.sha2(listed.cast("binary"), 256).alias("repaired_sha256"))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(done, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: The states of the grammar (0: nothing yet, 1: behind the system turn, 2: assistant due, 3: user due), turn by turn, each with
#: the least cost and audit that reach it; up to two insertions stand before a turn.
ORACLE_SQL = f"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h from conversations),
e as (select conv_id, turn, if(h = 4, 'user', role) as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(if(h = 3, 2, 1))) as copy from c where h <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from e),
x as (select *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as last, row_number() over (partition by conv_id, role, text order by pos) as copies, lag(left(role, 1)) over (partition by conv_id order by pos) as before from o),
t as (select conv_id, turn, role, text, pos, left(role, 1) as letter, before, case when last = '' then 'blank' when copies > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault from x),
moves(state, middle, spent, letters) as (values (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edits(middle, due, target) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
steps as (select m.state, m.letters, m.spent, s.middle, s.due, s.target from moves m join edits s using (middle)
  union all select state, letters, spent, middle, null, middle from moves),
path(conv_id, pos, state, best) as (
  select distinct conv_id, 0::bigint, 0, {{'cost': 0, 'audit': ''}} from t
  union all
  select p.conv_id, t.pos, s.target, min({{
    'cost': p.best.cost + s.spent + case when s.due is null then 4 else if(t.letter = s.due, 0, 3) + if(t.fault = 'truncated', 3, 0) end,
    'audit': p.best.audit || s.letters || case when s.due is null then 'D' when t.letter = s.due then 'K' else 'R' end}})
  from path p join t on t.conv_id is not distinct from p.conv_id and t.pos = p.pos + 1 join steps s on s.state = p.state
  where s.due is null or (t.fault not in ('blank', 'duplicate') and (s.due <> 's' or t.letter = 's'))
  group by p.conv_id, t.pos, s.target),
ends as (select p.conv_id, min({{'cost': p.best.cost + m.spent, 'audit': p.best.audit || m.letters}}) as best
  from path p join (select conv_id, max(pos) as pos from t group by conv_id) l on l.conv_id is not distinct from p.conv_id and l.pos = p.pos join moves m on m.state = p.state
  where m.middle = 3 or (m.state = 0 and m.middle = 0) group by p.conv_id),
letters as (select conv_id, best.audit as audit, unnest(string_split(best.audit, '')) as edit, unnest(range(1, 1 + len(best.audit))) as nth from ends where best.audit <> ''),
placed as (select *, count(*) filter (edit <> 'I') over w as pos, count(*) filter (edit <> 'D') over w as k, count(*) filter (edit <> 'D') over (partition by conv_id) as m from letters window w as (partition by conv_id order by nth)),
texts as (select p.conv_id, string_agg(case when edit = 'K' then t.role when (m - k) % 2 = 0 then 'assistant' else 'user' end || ':' || if(edit = 'I', '', t.text), chr(10) order by nth) as repaired
  from placed p left join t on t.conv_id is not distinct from p.conv_id and t.pos = p.pos where edit <> 'D' group by p.conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (pos > 1 and before || letter not in ('su', 'ua', 'au')) as illegal from t group by conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts n on n.conv_id is not distinct from i.conv_id left join ends e on e.conv_id is not distinct from i.conv_id
  left join texts x on x.conv_id is not distinct from i.conv_id
"""
