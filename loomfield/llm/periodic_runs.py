"""Operator 11: periodic runs of words, found by block convolution, and texts without their repeats.

A run is a stretch of words with smallest period q and a length of at least ``LEAST`` words and ``TIMES`` periods that no
neighbour extends. Each text is cut into blocks of B words, for B = 8, 16, 32 and so on. A run of period q in [B, 2B) (or
under 16, for B = 8) holds a whole block whose copy q words on lies in it too. So each block is laid over the windows that
follow it, and the sums of squared differences at all distances come from one number-theoretic transform each: words are
numbered by small hash classes, of which B squares stay below the prime, so residues are the sums themselves. Where a sum is
zero, block and window agree in every class, and the distance seeds an extension to both sides on the words' 64-bit hashes.
Of the stretches that come out, those long enough are runs, each under its smallest period, and are compared word by word.

The transform of a block serves as pattern and, added to its neighbour's, as half of a window: one forward and one backward
transform per block and size. Periods past the largest block are found with that block in later windows.

Defined cases: null and empty texts have no words and no runs; texts of one repeated word are one run; each row is worked on
by itself, so repeated rows, shared and null ids give rows of their own; other columns are not read; an empty table gives no
rows. A text is one task's work, in memory linear in its words, and time of n log(n)^2.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import byte_slices, crc32_sql, space_table, text_bytes, words_in
from loomfield.llm.suffix_dedup import Hashes

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: 7 * 2**20 + 1 is prime and 3 generates its units, so there are transforms of every power of two up to 2**20; sums of 32
#: products stay below 2**53, where doubles are exact.
PRIME, GENERATOR = 7340033, 3
SMALLEST, LARGEST, RADIX = 8, 1 << 19, 32
#: Numbers that are transformed at a time, and bytes of text that are searched together, about.
CHUNK, SLICE = 1 << 17, 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    return x - np.floor(x / PRIME) * PRIME


@functools.lru_cache(64)
def _powers(n: int, inverse: bool) -> np.ndarray:
    """w**0 to w**(n - 1) for a root of unity w of order n."""
    w = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(n)
    done = 1
    while done < n:
        out[done : 2 * done] = _mod(out[:done] * float(pow(w, done, PRIME)))
        done *= 2
    return out


@functools.lru_cache(64)
def _matrix(n: int, inverse: bool) -> np.ndarray:
    at = np.arange(n)
    return _powers(n, inverse)[np.outer(at, at) % n]


@functools.lru_cache(64)
def _twiddles(n1: int, n2: int, inverse: bool) -> np.ndarray:
    return _powers(n1 * n2, inverse)[np.outer(np.arange(n2), np.arange(n1))]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two of residues), exact; the inverse one without its factor."""
    m, n = rows.shape
    if n <= RADIX:
        return _mod(rows @ _matrix(n, inverse))
    n1 = min(RADIX, 1 << (n.bit_length() // 2))
    n2 = n // n1
    a = _mod(rows.reshape(m, n1, n2).transpose(0, 2, 1).reshape(-1, n1) @ _matrix(n1, inverse)).reshape(m, n2, n1)
    a = _mod(a * _twiddles(n1, n2, inverse))
    a = transform(np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(-1, n2), inverse)
    return a.reshape(m, n1, n2).transpose(0, 2, 1).reshape(m, n)


def occurrences(blocks: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block numbers, distances) at which a block of small numbers has no mismatch with the words that follow it, for the
    distances in [window * B, (window + 1) * B); the last window + 1 blocks are only looked into."""
    count, size = blocks.shape
    n, last = 2 * size, count - window - 1
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    turned = -np.arange(n) % n
    factor = float(pow(n, -1, PRIME))
    step = max(1, CHUNK // n)
    for begin in range(0, last, step):
        end = min(last, begin + step)
        part = blocks[begin : end + window + 1]
        padded = np.zeros((len(part), n))
        padded[:, :size] = part
        spectrum = transform(padded)
        own, near, far = spectrum[: end - begin], spectrum[window:-1], spectrum[window + 1 :]
        products = _mod(own[:, turned] * _mod(near + sign * far))
        dot = _mod(transform(products, inverse=True)[:, :size] * factor)
        squares = np.zeros((end - begin, n + 1))
        squares[:, 1 : size + 1], squares[:, size + 1 :] = part[window:-1] ** 2, part[window + 1 :] ** 2
        np.cumsum(squares, axis=1, out=squares)
        energy = squares[:, size:n] - squares[:, :size] + (part[: end - begin] ** 2).sum(axis=1)[:, None]
        block, offset = np.nonzero(energy == 2 * dot)
        distance = offset + window * size
        yield block[distance > 0] + begin, distance[distance > 0]


def _longest(same, most: np.ndarray) -> np.ndarray:
    """The largest k up to ``most`` for which same(k) holds, by bisection; same holds up to some k."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        good = same(middle)
        low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
    return low


def _stretches(words: np.ndarray, distance: int, first: int, end: int) -> list[tuple[int, int]]:
    """All stretches of a text, long enough for a run, whose words equal those ``distance`` on, by plain comparison."""
    edges = np.flatnonzero(words[first : end - distance] != words[first + distance : end]) + first
    edges = np.concatenate([[first - 1], edges, [end - distance]])
    found = np.stack([edges[:-1] + 1, edges[1:] + distance], axis=1)
    return [tuple(x) for x in found[found[:, 1] - found[:, 0] >= max(LEAST, TIMES * distance)].tolist()]


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of the texts in an array of word hashes, text i at offsets[i] to offsets[i + 1]: rows (text, start, length,
    period) by text, start, period; starts count from the text's first word."""
    lengths, h, size = np.diff(offsets), None, SMALLEST
    found: list[np.ndarray] = []
    reach, period_at = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    while size <= LARGEST and (long := np.flatnonzero(lengths >= max(LEAST, TIMES * size if size > SMALLEST else 0))).size:
        last = 1 if size < LARGEST else int(lengths.max()) // (TIMES * size)
        own = lengths[long]
        # Blocks of one text after the other; what is behind a text's end has a class of its own, which no word has.
        classes = int((PRIME - 1) // size) ** 0.5 // 1
        per_text = -(-own // size) + last + 1
        begin = np.concatenate([[0], np.cumsum(per_text)])
        blocks = np.full(begin[-1] * size, classes)
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        blocks[np.repeat(begin[:-1] * size, own) + inside] = (words[np.repeat(offsets[long], own) + inside] >> np.uint64(17)) % np.uint64(classes)
        blocks = blocks.reshape(-1, size)
        for window in range(0 if size == SMALLEST else 1, last + 1):
            for block, distance in occurrences(blocks, window):
                text = np.searchsorted(begin, block, side="right") - 1
                seed = (block - begin[text]) * size
                whole = seed + size + distance <= own[text]
                if not whole.any():
                    continue
                text, seed, distance = long[text[whole]], seed[whole], distance[whole]
                a = seed + offsets[text]
                # A block and its copy in one stretch that is known, a whole number of its periods apart, show it again.
                new = (reach[a] < a + distance + size) | (distance % period_at[a] > 0)
                if not new.any():
                    continue
                text, a, distance = text[new], a[new], distance[new]
                h = h or Hashes(words)
                b, z = a + distance, offsets[text + 1]
                right = _longest(lambda k, a=a, b=b: h.of(a, a + k) == h.of(b, b + k), z - b)
                left = _longest(lambda k, a=a, b=b: h.of(a - k, a) == h.of(b - k, b), a - offsets[text])
                long_enough = (right >= size) & (left + right + distance >= np.maximum(LEAST, TIMES * distance))
                found.append(np.unique(np.stack([text, a - left, b + right, distance])[:, long_enough], axis=1))
                for _, start, end, period in found[-1][:, ::-1].T.tolist():
                    reach[start:end], period_at[start:end] = end, period
        size *= 2
    # One stretch under several periods has the smallest for its own: of three periods and more, the others are its multiples.
    period_of: dict[tuple[int, int, int], int] = {}
    for text, start, end, period in (np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)).T.tolist():
        stretches = [(start, end)]
        if period_of.get((text, start, end), period + 1) <= period:
            continue
        if not np.array_equal(words[start : end - period], words[start + period : end]):  # equal hashes of unlike stretches
            stretches = _stretches(words, period, int(offsets[text]), int(offsets[text + 1]))
        for s, e in stretches:
            period_of[text, s, e] = min(period, period_of.get((text, s, e), period))
    runs = [(text, s - int(offsets[text]), e - s, q) for (text, s, e), q in period_of.items()]
    return np.array(sorted(runs, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run (start, length, period) holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: all runs by start and period, and the text's words without those that a run
    repeats, joined by spaces."""

    def run(batches):
        import pyarrow as pa

        is_word = space_table()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for begin, end in byte_slices(batch.column(1), SLICE):
                column = batch.column(1).slice(begin, end - begin)
                data, offsets = text_bytes(column)
                _, _, hashes, text = words_in(data, offsets, is_word)
                counts = np.bincount(text, minlength=len(column))
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
                for t, *r in find_runs(hashes, np.concatenate([[0], np.cumsum(counts)])).tolist():
                    runs[t].append(tuple(r))
                out = []
                for i, x in enumerate(column):
                    words = (x.as_py() or "").encode().split()
                    out.append(b" ".join([words[k] for k in kept_words(len(words), runs[i]).tolist()] if runs[i] else words))
                listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(counts, pa.int64()), listed, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The texts that the query searches: of one id in ten, the words from some place on repeat a first part of theirs. A null
    id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    x = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")).withColumn("chosen", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    x = x.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    x = x.withColumn("a", F.expr("if(n > 0, g % n, 0L)")).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    text = F.expr("array_join(transform(words, (w, i) -> get(words, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return x.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def _largest(runs: Column) -> Column:
    """The run with the greatest length over period, exactly; of equals the first."""
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def report(docs: DataFrame) -> DataFrame:
    """Counts, the greatest run, and digests of all runs and of the collapsed text."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    done = collapse(docs).withColumn("best", _largest(F.col("runs")))
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )


#: Word pairs at every distance up to a third of the text, gaps and islands per distance, and the smallest period of each stretch.
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as own, coalesce({crc32_sql("doc_id::varchar")}, 1) as h from documents),
e as (select *, len(own) as n, h // 10 as g, if(h % 10 = 0 and len(own) > 0, (h // 10) % len(own), len(own)) as a from d),
f as (select *, 1 + (n - a) // (3 + g % 8) as p from e),
t as (select r, doc_id, n, list_transform(range(n), lambda i: own[1 + if(i < a, i, a + (i - a) % p)]) as words from f),
w as (select r, n, unnest(words) as word, unnest(range(n)) as i from t),
pairs as (select x.r, y.i - x.i as q, x.i from w x join w y on x.r = y.r and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
islands as (select *, i - row_number() over (partition by r, q order by i) as island from pairs),
stretches as (select r, q, min(i) as start, count(*) + q as length from islands group by r, q, island having count(*) + q >= greatest({LEAST}, {TIMES} * q)),
runs as (select r, start, length, min(q) as period from stretches group by all),
listed as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
  first({{'start': start, 'length': length, 'period': period}} order by length / period desc, start, period) as best from runs group by r),
kept as (select r, string_agg(word, ' ' order by i) as words from w where not exists (select 1 from runs x where x.r = w.r and w.i >= x.start + x.period and w.i < x.start + x.length) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.words, '')) as collapsed_sha256, n as n_words
from t left join listed using (r) left join kept using (r)
"""
