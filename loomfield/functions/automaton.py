"""Many terms searched for in one pass over each text: an Aho-Corasick automaton in the tasks, from a table of terms.

The table goes to every task, so it is collected only behind a check of its size in bytes (``MOST_BYTES``, of which a task's
automaton takes some ten times as much); whoever has a larger one joins it by words instead (``rules.skills``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of terms above this is not sent to the tasks.
MOST_BYTES = 32 << 20

_SPACE = re.compile(r"\s+")


def folded(text: str) -> str:
    """Lower case, one character for each: characters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def collected(terms: DataFrame) -> tuple[tuple, ...]:
    """The rows of a table of terms, sorted, if they are small enough for every task."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in terms.columns]
    total = terms.agg(F.sum(functools.reduce(lambda a, b: a + b, sizes) + F.lit(16)).alias("bytes")).first()["bytes"] or 0
    if total > MOST_BYTES:
        raise ValueError(f"a table of terms of {total} bytes is too large for every task ({MOST_BYTES}); join it by words instead")
    return tuple(sorted((tuple(r) for r in terms.distinct().collect()), key=str))


class Matcher:
    """Terms with values. ``edge``: a class of characters that may not stand next to a term."""

    def __init__(self, terms: Iterator[tuple[str, object]], edge: str, exact: bool = False):
        import ahocorasick

        self.exact, self.edge, self.automaton, self.known = exact, re.compile(edge), ahocorasick.Automaton(), False
        for term, value in terms:
            term = _SPACE.sub(" ", term.strip())
            if term:
                term = term if exact else folded(term)
                self.automaton.add_word(term, (len(term), value))
                self.known = True
        if self.known:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, object]]:
        """(start, end, value) of the terms in a text whose white space is single blanks: leftmost first, of those that start
        together the longest, none inside or across another."""
        if not self.known:
            return []
        hits, edge = [], self.edge
        for last, (length, value) in self.automaton.iter(text if self.exact else folded(text)):
            start, end = last - length + 1, last + 1
            if (start and edge.match(text[start - 1])) or (end < len(text) and edge.match(text[end])):
                continue
            hits.append((start, -end, value))
        hits.sort(key=lambda h: h[:2])
        out, at = [], 0
        for start, end, value in hits:
            if start >= at:
                out.append((start, -end, value))
                at = -end
        return out


def single_blanks(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
