"""Operator 9: removal of repeated byte strings by blocks of content-chosen suffixes.

The result is exact (up to equal 64-bit hash pairs): a byte goes if a string of ``LENGTH`` bytes over it also starts earlier,
in an earlier document or further left in the same one. No Burrows-Wheeler transform is built; the README gives the figures
that ruled it out. Suffixes are sampled where the content says so: every window of LENGTH bytes picks the start of its
least-hashed ``SYMBOL`` bytes, so equal windows pick the same place, and about one byte in 27 is a suffix. Suffixes are put
into blocks and the blocks are split by more context, round by round; a suffix alone in its block shares no such string and
leaves. Round 1 splits by the symbol at the suffix, round 2 by the whole context of the windows that picked it (left and
right of it), and round 3, for symbols that round 2 split, by each window's bytes. Windows that share their last block with
an earlier one are repeated.

A passage that a third of all documents hold is one block. Symbols of that kind are found in a sample of ``HOT_TEXTS`` texts
(at most ``HOT_MOST`` symbols, which decide only how rows are dealt): their blocks are dealt over ``SALTS`` parts, each part
keeps its first member, and the firsts meet in a second step, at most SALTS for a block.

Defined cases: documents are ordered by id, a null id before all others, and texts under one id by their 64-bit xxHash, and
all of them are searched; null and empty texts have no bytes; exact copies of an earlier document of at least LENGTH bytes go
whole, shorter ones stay; repeated rows (same id and text) are one document and get the same result each; other columns are
not read. An empty table gives no rows. Texts are read whole, in pieces whose windows overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfield.llm import common
from loomfield.llm.common import byte_slices, mixed, text_bytes, written

LENGTH, SYMBOL = 100, 48
#: Bytes that are hashed at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
#: Texts to sample for symbols that many texts hold, in how many of them such a symbol stands, and how many are listed at most.
HOT_TEXTS, HOT_LEAST, HOT_MOST = 20_000, 20, 100_000
#: Parts over which the block of such a symbol is dealt.
SALTS = 256


class Hashes:
    """Hashes of any stretch of a buffer, from sums of its bytes times powers of an odd number."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        common._grow(n + 1)
        self.sums, self.inverse = np.zeros(n + 1, np.uint64), common._inverse
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * common._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def picked(h: Hashes, n: int, length: int, symbol: int) -> np.ndarray:
    """For each window of ``length`` bytes in a buffer of n, the place of its least symbol, the leftmost of equal ones."""
    at = np.arange(n - symbol + 1)
    # The upper 33 bits of the hash, then the place: of equal hashes the leftmost is the least.
    key = (h.of(at, at + symbol) >> np.uint64(31) << np.uint64(31)) | at.astype(np.uint64)
    wide, done = length - symbol + 1, 1
    while done * 2 <= wide:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < wide:
        key = np.minimum(key[: len(key) - (wide - done)], key[wide - done :])
    return (key & np.uint64((1 << 31) - 1)).astype(np.int64)


def pieces(offsets: np.ndarray, length: int, most: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """(text number, start, end) of the pieces of each text in a buffer; windows that start in a piece end in it."""
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for start in range(a, max(a + 1, b - length + 1), most):
            if b - start >= length:
                yield i, start, min(b, start + most + length - 1)


def suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of the texts in a buffer: symbol hash, context hash, text number, first window that picked it
    (from the text's start) and the number of such windows."""
    out: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not group:
            return
        lo, hi = group[0][1], max(e for _, _, e in group)
        own, h = hi - lo, Hashes(data[lo:hi])
        if own < length:
            group.clear()
            return
        pick = picked(h, own, length, symbol)
        valid, text = np.zeros(len(pick), bool), np.full(len(pick), -1)
        for i, s, e in group:
            valid[s - lo : e - lo - length + 1] = True
            text[s - lo : e - lo - length + 1] = i
        at = np.flatnonzero(valid)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (pick[at[1:]] != pick[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
            first = at[new]
            count = np.diff(np.append(np.flatnonzero(new), len(at)))
            place = pick[first]
            context = h.of(first, first + count - 1 + length)
            with np.errstate(over="ignore"):
                context = mixed(context ^ ((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            out.append((h.of(place, place + symbol), context, text[first], first + lo - offsets[text[first]], count))
        group.clear()

    for piece in pieces(offsets, length):
        # Whole texts that lie next to each other are hashed together; a piece of a longer text alone.
        if group and (piece[0] == group[-1][0] or piece[2] - group[0][1] > PIECE + length):
            flush()
        group.append(piece)
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): documents are ordered by doc, then tie."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _distinct_here(batches, least: int) -> Iterator:
    """Batches of (doc, tie, text) without texts of under ``least`` bytes and without repeated rows of the same task, so that a
    row that fills a third of the table is searched once in a task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    seen: set[tuple[int, int]] = set()
    for batch in batches:
        batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column(2)), least))
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def common_symbols(own: DataFrame, length: int = LENGTH, symbol: int = SYMBOL) -> np.ndarray:
    """Hashes, ascending, of the symbols that stand in ``HOT_LEAST`` or more of about ``HOT_TEXTS`` sampled texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                sym, _, text, _, _ = suffixes(*text_bytes(batch.column(2).slice(a, b - a)), length, symbol)
                pairs = np.unique(np.stack([text, sym.view(np.int64)]), axis=1) if len(text) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1])], names=["sym"])

    n = own.count()
    some = own.sample(min(1.0, HOT_TEXTS / max(n, 1)), seed=9) if n > HOT_TEXTS else own
    counts = some.mapInArrow(run, "sym long").groupBy("sym").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    return np.array(sorted(r["sym"] for r in counts.orderBy(F.desc("n"), "sym").limit(HOT_MOST).collect()), np.int64)


def _salt(sym: np.ndarray, hot: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """0 for symbols that are not ``hot``, else a number from 1 to ``SALTS`` that the row's keys give."""
    if not len(hot) or not len(sym):
        return np.zeros(len(sym), np.int32)
    at = np.minimum(np.searchsorted(hot, sym), len(hot) - 1)
    h = np.zeros(len(sym), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = mixed(h * np.uint64(0x9FB21C651E98DF25) + k.view(np.uint64))
    return np.where(hot[at] == sym, (h % np.uint64(SALTS)).astype(np.int32) + 1, 0).astype(np.int32)


def removed(docs: DataFrame, length: int = LENGTH, symbol: int = SYMBOL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    own = _keyed(docs)
    hot = common_symbols(own, length, symbol)

    def sample(batches):
        import pyarrow as pa

        for batch in _distinct_here(batches, length):
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                sym, context, text, start, count = suffixes(*text_bytes(part.column(2)), length, symbol)
                doc, tie = part.column(0).to_numpy()[text], part.column(1).to_numpy()[text]
                sym, windows = sym.view(np.int64), start * 128 + count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sym), pa.array(context.view(np.int64)), pa.array(_salt(sym, hot, tie, windows)), pa.array(doc), pa.array(tie), pa.array(windows)], names=["sym", "context", "salt", "doc", "tie", "windows"]
                )

    order = ["doc", "tie", "windows"]
    first = lambda *block: F.rank().over(W.partitionBy(*block).orderBy(*order)) == 1
    # Rounds 1 and 2 in one exchange: blocks of one symbol, split by context. Of a block of round 2 the first member stays.
    rows = own.mapInArrow(sample, "sym long, context long, salt int, doc long, tie long, windows long").repartition("sym", "salt")
    ranked = rows.withColumn("first", first("sym", "salt", "context")).withColumn("blocks", F.count_if("first").over(W.partitionBy("sym", "salt")))
    dealt = F.col("salt") > 0
    shared = written(
        ranked.where(~F.col("first") | (F.col("blocks") > 1) | dealt).select("sym", F.when(dealt, F.col("context")).alias("context"), *order, "first", dealt.alias("dealt")), "suffix-blocks"
    )
    # The firsts of the parts of a dealt block meet; a symbol with several blocks goes on to round 3.
    met = written(shared.where("dealt and first").select("sym", "context", *order).withColumn("first", first("sym", "context")), "suffix-dealt")
    several = met.where("first").groupBy("sym").agg((F.min("context") != F.max("context")).alias("several")).where("several").select("sym")
    later = shared.where("not first").select("doc", "tie", "windows").unionAll(met.where("not first").select("doc", "tie", "windows"))
    start, count = F.shiftright("windows", 7), F.col("windows").bitwiseAND(127)
    whole = later.select("doc", "tie", start.alias("a"), (start + count - 1 + length).alias("z"))

    # Round 3: the windows of the first members of blocks that share a symbol. ``several`` has HOT_MOST rows at most.
    firsts = shared.where("first and not dealt").select("sym", *order).unionAll(met.where("first").join(F.broadcast(several), "sym", "left_semi").select("sym", *order))
    split = firsts.groupBy("doc", "tie").agg(F.collect_set(F.struct("sym", "windows")).alias("runs"))
    split = split.select("doc", "tie", F.transform("runs", lambda x: x["sym"]).alias("syms"), F.transform("runs", lambda x: x["windows"]).alias("windows"))
    once = own.mapInArrow(lambda batches: _distinct_here(batches, length), own.schema)
    texts = once.join(split.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "syms", "windows")

    def windows(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = text_bytes(batch.column(2).slice(i, 1))
                doc, tie = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                syms, packed = batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy()
                order = np.argsort(packed, kind="stable")
                packed, syms = packed[order], syms[order]
                first, n = packed >> 7, packed & 127
                lo = 0
                while lo < len(first):  # stretches of the text of about a piece each
                    base = int(first[lo])
                    hi = max(lo + 1, int(np.searchsorted(first, base + PIECE)))
                    end = int((first[lo:hi] + n[lo:hi]).max()) - 1 + length
                    h = Hashes(data[base:end])
                    at = np.repeat(first[lo:hi] - base - np.cumsum(n[lo:hi]) + n[lo:hi], n[lo:hi]) + np.arange(int(n[lo:hi].sum()))
                    own, whose = np.repeat(syms[lo:hi], n[lo:hi]), np.full(len(at), tie)
                    columns = [own, h.of(at, at + length).view(np.int64), _salt(own, hot, whose, at), np.full(len(at), doc), whose, at + base]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sym", "bytes", "salt", "doc", "tie", "windows"])
                    lo = hi

    each = texts.mapInArrow(windows, "sym long, bytes long, salt int, doc long, tie long, windows long")
    again = written(each.withColumn("first", first("sym", "bytes", "salt")).where(~F.col("first") | dealt), "suffix-windows")
    met_again = again.where("first").withColumn("first", first("sym", "bytes"))
    repeated = again.where("not first").unionAll(met_again.where("not first")).select("doc", "tie", F.col("windows").alias("a"), (F.col("windows") + length).alias("z"))
    gone = whole.unionAll(repeated).groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    return _cut(own, gone.select("doc", "tie", F.transform("spans", lambda x: x["a"]).alias("a"), F.transform("spans", lambda x: x["z"]).alias("z")))


def merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the intervals [a, z); intervals that touch are one run."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    at = np.flatnonzero(new)
    return a[at], z[np.append(at[1:], len(a)) - 1]


def _cut(own: DataFrame, gone: DataFrame) -> DataFrame:
    """The result per row, from the spans of each document. Spans grow with the texts, so both sides shuffle at every size."""
    ready = own.join(gone.hint("merge"), ["doc", "tie"], "left").select("doc", "text", "a", "z")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                data, _ = text_bytes(batch.column(1).slice(i, 1))
                n_bytes.append(len(data))
                runs = lost = 0
                if batch.column(2)[i].is_valid:
                    a, z = merged(batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy())
                    runs, lost = len(a), int((z - a).sum())
                    bounds = np.concatenate([[0], np.stack([a, z], 1).ravel(), [len(data)]])
                    data = np.concatenate([data[s:e] for s, e in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True)])
                n_removed.append(lost)
                n_spans.append(runs)
                kept.append(hashlib.sha256(data.tobytes()).hexdigest())
            doc = pa.array([None if d == NO_ID else d for d in batch.column(0).to_pylist()], pa.int64())
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([doc, longs(n_bytes), longs(n_removed), longs(n_spans), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return ready.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
