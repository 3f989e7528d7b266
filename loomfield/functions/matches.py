"""Matches of a pattern with the characters around them, for rules that look at what stands before and behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where the value is worked out once, however often it is used: it is read as an array's one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A cheap test that holds at every begin of a word, for patterns that begin with one.
WORD = r"(?<![A-Za-z])(?!\s)"
#: Code points that no text may interchange: they mark matches and their parts.
_MATCH, _PART = "\ufffe", "\uffff"


def around(text: Column, pattern: str, before: int, after: int, groups: int = 0, test: str | None = None, start: str = "") -> Column:
    """Array of struct(before, said, after, g1 to gN) by match, in order: up to ``before`` and ``after`` characters on its sides,
    across earlier and later matches, and the pattern's groups. ``test`` is the pattern without groups; it stands in front,
    so that the sides are only taken where there is a match. ``start``, a cheap test that holds wherever a match begins, stands
    in front of both. Null and texts without a match give an empty array.

    The pattern runs over a text once: matches are marked in it, and the text is split at the marks. Texts that hold the marks
    themselves are searched once for each part."""
    bare = test or pattern
    # A look-behind grows from nothing: the first branch holds near the start of the text only.
    front = rf"(?<=(\A(?s:.{{0,{before - 1}}})|(?s:.{{{before}}})))"
    wide = rf"{start}(?={bare}){front}({pattern})(?=((?s:.{{0,{after}}})))"
    named = {"before": 1, "said": 2, **{f"g{i}": i + 2 for i in range(1, groups + 1)}, "after": groups + 3}
    part = lambda p, i: F.get(p, F.lit(i - 1))

    def found(own: Column) -> Column:
        marked = F.regexp_replace(own, F.lit(wide), F.lit(_MATCH + _PART.join(f"${i}" for i in range(1, groups + 4)) + _MATCH))
        pieces = F.filter(F.split(marked, _MATCH), lambda _, i: i % 2 == 1)
        once = F.transform(pieces, lambda x: let(F.split(x, _PART), lambda p: F.struct(*[part(p, i).alias(n) for n, i in named.items()])))
        by_part = F.arrays_zip(*[F.regexp_extract_all(own, F.lit(wide), F.lit(i)).alias(n) for n, i in named.items()])
        return F.when(F.contains(own, F.lit(_MATCH)) | F.contains(own, F.lit(_PART)), by_part).otherwise(once)

    return let(F.coalesce(text, F.lit("")), found)


def at_words(pattern: str) -> str:
    """A pattern whose every branch begins with ``\\b`` and a letter, digit or underscore, with a cheap test in front that passes over the insides of words."""
    return f"{WORD}(?:{pattern})"


def first(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return let(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0), lambda said: F.nullif(said, F.lit("")))


def ungrouped(pattern: str) -> str:
    """A pattern whose groups don't capture. It must hold no bare bracket inside a character class."""
    out = ""
    for i, c in enumerate(pattern):
        out += "(?:" if c == "(" and pattern[i + 1] != "?" and pattern[i - 1 : i] != "\\" else c
    return out
