"""Operator 8: license scans by template markup.

A template is license text with markup: ``[[ ... ]]`` is an optional region, ``{{n}}`` a replaceable region of at most n
words. Templates are compiled into token automata (states are places in the wording; optional regions add empty moves,
replaceable ones loops with a limit). A text is accepted where its words run through the whole mandatory wording exactly.
Words are hashed for whole Arrow batches; automata start only where three words stand that can begin a template, so texts
without license wording cost one vectorised search. ``license_texts`` holds the templates. The score is the strongest
evidence of a license: 0 for none, 0.5 for a base phrase, 0.75 for a notice that names a license, 1 for a whole license text.

Defined cases: a null text is empty; texts without a phrase have n_base 0, null places and empty labels; rows are judged
one by one, so repeated rows and ids stay; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import byte_slices, shingles, text_bytes, words_in
from loomfield.llm.license_texts import NOTICES, TEXTS

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = TEXTS | NOTICES
#: Scores: a base phrase only, a notice that names a license, a whole license text.
PHRASE_SCORE, NOTICE_SCORE, TEXT_SCORE = 0.5, 0.75, 1.0
#: Words in front of a template by which places to start its automaton are found.
HEAD = 3


def word_table() -> np.ndarray:
    """Which bytes belong to words: letters and digits of ASCII (after lower-casing), and all of other characters."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


def tokens(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@dataclass
class Automaton:
    """``moves[state]``: by word, the next states; ``skips[state]``: empty moves; ``any[state]``: next state on any word.
    State 0 starts, the last one accepts."""

    moves: list[dict[str, list[int]]]
    skips: list[list[int]]
    any: list[list[int]]

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def longest(self, words: list[str], start: int) -> int:
        """End of the longest run from ``start`` that is accepted, or -1. A state set per word: no backtracking."""
        now, best, last = self.closure({0}), -1, len(self.moves) - 1
        for i in range(start, len(words) + 1):
            if last in now:
                best = i
            if i == len(words) or not now:
                break
            now = self.closure({t for s in now for t in (*self.moves[s].get(words[i], ()), *self.any[s])})
        return best

    def heads(self, n: int) -> set[tuple[str, ...]]:
        """All runs of n words that can start an accepted text; an error if a replaceable region may stand there."""
        paths = {((), frozenset(self.closure({0})))}
        for _ in range(n):
            if any(self.any[s] for _, now in paths for s in now):
                raise ValueError(f"a template must start with {n} words of its own")
            paths = {
                ((*p, w), frozenset(self.closure({t for s in now for t in self.moves[s].get(w, ())})))
                for p, now in paths
                for w in {w for s in now for w in self.moves[s]}
            }
        return {p for p, _ in paths}


def compile_template(markup: str) -> Automaton:
    """Token automaton of a template. The optional regions nest; a replaceable region of n words is n any-moves in a row,
    each of which may be skipped."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", markup)
    a = Automaton([{}], [[]], [[]])

    def state() -> int:
        a.moves.append({})
        a.skips.append([])
        a.any.append([])
        return len(a.moves) - 1

    now, opened = 0, []
    for part in parts:
        if part == "[[":
            opened.append(now)
        elif part == "]]":
            a.skips[opened.pop()].append(now)
        elif part.startswith("{{"):
            places = [now]
            for _ in range(int(part[2:-2])):
                new = state()
                a.any[now].append(new)
                now = new
                places.append(now)
            for p in places[:-1]:
                a.skips[p].append(now)
        else:
            for w in tokens(part):
                new = state()
                a.moves[now].setdefault(w, []).append(new)
                now = new
        if part == "]]":  # what follows starts at a state of its own, so that a region can't be entered from its end
            new = state()
            a.skips[now].append(new)
            now = new
    if opened:
        raise ValueError("a template's optional region isn't closed")
    return a


class Matcher:
    def __init__(self):
        self.word, self.lower = word_table(), lower_table()
        self.automata = {k: compile_template(v) for k, v in TEMPLATES.items()}
        starts: dict[int, list[str]] = {}
        for k, a in self.automata.items():
            for head in a.heads(HEAD):
                starts.setdefault(int(self._run_hashes(" ".join(head))[0]), []).append(k)
        self.heads = np.array(sorted(starts), np.uint64)
        self.starts = [starts[int(h)] for h in self.heads]
        #: So many words at most can belong to the longest template.
        self.most = max(len(a.moves) for a in self.automata.values())
        self.base_hashes = {p: self._hashes(p) for p in BASE}

    def _hashes(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return words_in(data, np.array([0, len(data)]), self.word)[2]

    def _run_hashes(self, text: str) -> np.ndarray:
        h = self._hashes(text)
        return shingles(h, np.zeros(len(h), np.int64), HEAD)[0]

    @staticmethod
    def _places(hashes: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        n = len(hashes) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(hashes[:n] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[hashes[at + k] == phrase[k]]
        return at[text[at] == text[at + len(phrase) - 1]]

    def run(self, column):
        """Per text of an Arrow column: n_words, n_base, first, last (-1: none), base labels, labels, score."""
        data, offsets = text_bytes(column)
        data = self.lower[data]
        starts, ends, hashes, text = words_in(data, offsets, self.word)
        n = len(offsets) - 1
        counts = np.bincount(text, minlength=n)
        begin = np.concatenate([[0], np.cumsum(counts)])
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        base: dict[int, set[str]] = {}
        for phrase, label in BASE.items():
            at = self._places(hashes, text, self.base_hashes[phrase])
            for d, w in zip(text[at].tolist(), (at - begin[text[at]]).tolist(), strict=True):
                n_base[d] += 1
                first[d] = w if first[d] < 0 else min(first[d], w)
                last[d] = max(last[d], w)
                base.setdefault(d, set()).add(label)
        found: dict[int, set[str]] = {}
        own_text = np.flatnonzero(text[: max(len(text) - HEAD + 1, 0)] == text[HEAD - 1 :]) if len(text) >= HEAD else np.zeros(0, np.int64)
        runs = shingles(hashes, text, HEAD)[0]
        which = np.minimum(np.searchsorted(self.heads, runs), len(self.heads) - 1)
        hit = np.flatnonzero(self.heads[which] == runs)
        for at, w in zip(own_text[hit].tolist(), which[hit].tolist(), strict=True):
            d = int(text[at])
            names = [x for x in self.starts[w] if x not in found.get(d, ())]
            if names:
                own = [bytes(data[starts[i] : ends[i]]).decode() for i in range(at, min(int(begin[d + 1]), at + self.most))]
                found.setdefault(d, set()).update(x for x in names if self.automata[x].longest(own, 0) > 0)
        score = np.zeros(n)
        out, labels = [""] * n, [""] * n
        for d in base.keys() | found.keys():
            own_base, own_found = base.get(d, set()), found.get(d, set())
            out[d], labels[d] = ",".join(sorted(own_base)), ",".join(sorted(own_base | own_found))
            score[d] = TEXT_SCORE if own_found & TEXTS.keys() else NOTICE_SCORE if own_found else PHRASE_SCORE if own_base else 0.0
        return counts, n_base, first, last, out, labels, score


@lru_cache(maxsize=1)
def matcher() -> Matcher:
    return Matcher()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """License labels per row of ``docs``, in one narrow pass."""

    def run(batches):
        import pyarrow as pa

        own = matcher()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                counts, n_base, first, last, base, labels, score = own.run(part.column(1))
                place = lambda x: pa.array(x, pa.int64(), mask=x < 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int64)), pa.array(n_base), place(first), place(last), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score)], names=names
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _pattern(markup: str) -> str:
    """A regular expression over words that end with a space each, from a template's markup."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", markup)
    return "".join("(?:" if p == "[[" else ")?" if p == "]]" else f"(?:[^ ]+ ){{0,{p[2:-2]}}}" if p[0] == "{" else "".join(w + " " for w in tokens(p)) for p in parts)


def _oracle() -> str:
    base = " union all ".join(f"select doc_id, i - 1 as i, '{label}' as label from p where " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in BASE.items())
    found = " union all ".join(f"select doc_id, '{name}' as label, {TEXT_SCORE if name in TEXTS else NOTICE_SCORE} as s from t where regexp_matches(t, ' {_pattern(markup)}')" for name, markup in TEMPLATES.items())
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
b as ({base}),
c as (select doc_id, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as names from b group by doc_id),
t as (select doc_id, ' ' || array_to_string(w, ' ') || ' ' as t from w),
f as ({found}),
l as (select doc_id, string_agg(distinct label, ',' order by label) as names, max(s) as s from (select doc_id, label, s from f union all select doc_id, label, {PHRASE_SCORE} from b) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(c.n, 0) as n_base, lo as first_word, hi as last_word, coalesce(c.names, '') as base_labels, coalesce(l.names, '') as labels, cast(coalesce(s, 0) as double) as score
from w left join c using (doc_id) left join l using (doc_id)
"""


ORACLE_SQL = _oracle()
