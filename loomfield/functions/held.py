"""The words of a text that some rule asks for, found in one pass: a cheap test in front of all rules.

A rule names words of which a text must hold one for the rule to find anything. They are whole runs of a-z in either case
(patterns that also read glued wording name the glued runs), digits, signs of currencies, or begin with one of ``OPEN``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfield.functions.matches import let

#: Beginnings of words that count however the word goes on.
OPEN = ("sponsor",)
#: Characters that patterns with Unicode's cases take for a letter a-z (dotless i, long s; the lower case of a dotted I holds the dot above; the sign of kelvin is read as a long s).
KELVIN, ODD = "\u212a", ("\u0131", "\u017f", "\u0307")
DIGITS, SIGNS = tuple("0123456789"), tuple("₹$€£")
_TOKEN = f"{'|'.join(OPEN)}|[a-z]+|[{''.join(DIGITS + SIGNS + ODD)}]"
#: Texts of more bytes are not taken apart: all words count as held, so every rule reads them.
MOST_BYTES = 4 << 20
_known: set[str] = {*OPEN, *DIGITS, *SIGNS, *ODD}


def known(*words: str) -> tuple[str, ...]:
    """Words that a rule asks for; each holds some, parted by blanks."""
    out = tuple(w for some in words for w in some.split())
    _known.update(out)
    return out


def held(text: Column) -> Column:
    """Array of the known words that a text holds. Null texts hold none."""
    every = F.array(*[F.lit(w) for w in sorted(_known)])
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(ODD[1])))
    return F.when(F.octet_length(text) > MOST_BYTES, every).otherwise(F.array_intersect(F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0)), every))


def within(words: Column | None, text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the words that a text holds: those given, or else found here, once."""
    return let(held(text), use) if words is None else use(words)


def has(words: Column, asked: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in asked]))
