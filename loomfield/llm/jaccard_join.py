"""Operator 4: the n-gram Jaccard self-join by MinHash banding.

Texts are sets of hashed shingles of five words. Exact copies are collapsed first (one class per text, by its 128-bit
digest), so a text that fills a third of the table is one row from then on. The numbers of bands and rows are chosen for
the target recall at the threshold. Band hashes of the classes are shuffled; classes that share one are candidates, and
candidates are verified on their full shingle sets.

A bucket is never expanded into pairs of rows: its members meet in units of at most two blocks of ``BLOCK`` classes, and
a unit compares its members as arrays. Each pair is examined in the first band in which it agrees. A first pass over
units carries only band hashes and finds the members that meet a new partner there; only those carry their shingle sets to
the second pass, which counts links and joins linked members under one label per unit. Labels become groups by
min-label propagation with pointer jumping.

Defined cases: texts of one to four words are one shingle of all their words; null, empty and blank texts have no shingle and
link to nothing but their exact copies; rows with a null id are not documents and give no row here (``drop_near_copies``
keeps them); repeated rows are copies of each other; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import byte_slices, free_name, maybe_broadcast, mixed, shingles, space_table, text_bytes, words_in, written

WIDTH, THRESHOLD = 5, 0.8
#: Recall wanted for pairs exactly at the threshold; pairs above it are found more surely.
RECALL = 0.9999
#: Hash functions to spend at most.
MOST_HASHES = 200
#: Classes in a block of a large bucket; a unit holds two blocks.
BLOCK = 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, whose bands reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def shingle_sets(column, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of an Arrow column, ascending, one after the other, and len + 1 offsets."""
    data, offsets = text_bytes(column)
    _, _, hashes, text = words_in(data, offsets, space_table())
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    h, own = shingles(hashes, text, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        with np.errstate(over="ignore"):
            for d in short:
                x = np.array([counts[d]], np.uint64)
                for w in hashes[begin[d] : begin[d + 1]]:
                    x = mixed(x * np.uint64(0x9FB21C651E98DF25) + w)
                extra.append(x[0])
        h, own = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[first], own[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def band_hashes(h: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[texts, bands] band hashes; rows of texts without shingles mean nothing."""
    n = len(offsets) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    a, b = _multipliers(bands * rows)
    starts = offsets[full]
    with np.errstate(over="ignore"):
        for band in range(bands):
            x = np.full(len(full), band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                x = mixed(x * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(h * a[k] + b[k], starts))
            out[full, band] = x
    return out


def _lists(values: np.ndarray, offsets: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(k, doc_id, sig): the text's digest, and its band hashes (none without shingles)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in byte_slices(batch.column(2)):
                part = batch.slice(i, j - i)
                h, offsets = shingle_sets(part.column(2))
                sig = band_hashes(h, offsets, bands, rows)
                has = np.diff(offsets) > 0
                ends = np.concatenate([[0], np.cumsum(has * bands)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(sig[has].ravel().view(np.int64), ends, pa.int64())], names=["k", "doc_id", "sig"])

    return with_digest(docs).mapInArrow(run, "k binary, doc_id long, sig array<long>")


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.unhex(F.md5(text.cast("binary"))).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, shingles as bytes) of the wanted classes, from the row of each class's smallest id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in byte_slices(batch.column(1)):
                part = batch.slice(i, j - i)
                h, offsets = shingle_sets(part.column(1))
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["k", "shingles"])

    own = with_digest(docs)
    mine = own.join(maybe_broadcast(wanted), ["k", "doc_id"], "left_semi").select("k", "text")
    return mine.mapInArrow(run, "k binary, shingles binary").groupBy("k").agg(F.first("shingles").alias("shingles"))


# --- units ------------------------------------------------------------------------------------------------------------

UNIT = ("bucket", "i", "j")


def _units(batches) -> Iterator:
    """Arrow tables with all rows of one unit each, from batches that are sorted by unit."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in UNIT]
        change = np.zeros(batch.num_rows, bool)
        for x in keys:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(x[a]) for x in keys)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def new_pairs(sig: np.ndarray, band: int, side: np.ndarray, i: int, j: int) -> np.ndarray:
    """[n, n] bool, above the diagonal: pairs of the unit that agree in no band before ``band``; between different blocks
    only pairs across them."""
    n = len(sig)
    fresh = np.triu(np.ones((n, n), bool), 1)
    if i != j:
        fresh &= side[:, None] != side[None, :]
    for b in range(band):
        fresh &= sig[:, None, b] != sig[None, :, b]
    return fresh


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[i], b[i]) of ascending sets."""
    if len(a) <= 4 * len(sets):
        out = np.empty(len(a), np.int64)
        for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = sets[x], sets[y]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[n] = np.count_nonzero(y[at] == x)
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        s, e = np.searchsorted(place, [lo, lo + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[s:e], place[s:e] - lo] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index that each of n members is linked to, directly or not."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meeting(batches):
    """First pass: members of a unit that meet a new partner there."""
    import pyarrow as pa

    for t in _units(batches):
        n = t.num_rows
        sig = t["sig"].combine_chunks().values.to_numpy().reshape(n, -1)
        fresh = new_pairs(sig, t["band"][0].as_py(), t["side"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py())
        keep = fresh.any(0) | fresh.any(1)
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


LINKS = "k binary, label binary, classes long, documents long"


def _linking(threshold: float):
    def run(batches):
        """Second pass: per member of a unit with links there, its label and the numbers of classes and documents linked."""
        import pyarrow as pa

        for t in _units(batches):
            n = t.num_rows
            sig = t["sig"].combine_chunks().values.to_numpy().reshape(n, -1)
            a, b = np.nonzero(new_pairs(sig, t["band"][0].as_py(), t["side"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()))
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets])
            near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            a, b = a[near], b[near]
            if not len(a):
                continue
            both = common_counts(sets, a, b)
            # 1e-9: a ratio that equals the threshold counts, however the division rounds.
            linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            weight, k = t["n"].to_numpy(), t["k"].to_pylist()
            classes = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            documents = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            label = labels_of(n, a, b)
            own = np.flatnonzero(classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[x] for x in own], pa.binary()), pa.array([k[label[x]] for x in own], pa.binary()), pa.array(classes[own].astype(np.int64)), pa.array(documents[own].astype(np.int64))], names=["k", "label", "classes", "documents"]
            )

    return run


def groups_of(edges: DataFrame) -> DataFrame:
    """(k, root): the smallest node of each node's component, by min-label propagation and pointer jumping. ``edges``:
    (k, label) in any direction. Each round is written, so lineage stays short."""
    both = edges.select("k", F.col("label").alias("o")).union(edges.select(F.col("label").alias("k"), F.col("k").alias("o"))).where("k <> o").distinct()
    both = written(both, "jaccard-edges")
    labels = written(both.groupBy("k").agg(F.least(F.col("k"), F.min("o")).alias("root")), "jaccard-roots")
    while True:
        theirs = labels.select(F.col("k").alias("o"), F.col("root").alias("theirs"))
        best = both.join(theirs, "o").groupBy("k").agg(F.min("theirs").alias("theirs"))
        spread = labels.join(best, "k").select("k", F.col("root").alias("old"), F.least("root", "theirs").alias("root"))
        up = labels.select(F.col("k").alias("root"), F.col("root").alias("above"))
        new = written(spread.join(up, "root", "left").select("k", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "jaccard-roots")
        if not new.where("root <> old").head(1):
            return new.select("k", "root")
        labels = new.select("k", "root")


def links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document (row with an id): doc_id, class_id (the smallest id that links, direct or not, lead to), copy_id
    (the smallest id with this very text), n_links (other documents with a similarity of ``threshold`` or more, copies among
    them) and n_text_links (other texts among them)."""
    return _links(docs, threshold, recall).drop("k", "root")


def _links(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``links`` with the digest of each row's text as k, and root, the smallest digest of its group."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, bands, rows), "jaccard-signatures")
    classes = written(signed.groupBy("k").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n"), F.first("sig").alias("sig")), "jaccard-classes")

    banded = classes.select("k", F.posexplode("sig").alias("band", "bucket"))
    members = banded.withColumn("m", F.count("*").over(W.partitionBy("bucket", "band"))).where("m > 1")
    members = written(members, "jaccard-members")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "k"
    )
    weighted = spread.join(classes.select("k", "n", "sig"), "k")

    def by_unit(df: DataFrame) -> DataFrame:
        return df.repartition(*[F.col(c) for c in UNIT]).sortWithinPartitions(*UNIT)

    order = ["bucket", "band", "i", "j", "side", "k", "n", "sig"]
    kind = T.StructType([weighted.schema[c] for c in order])
    meeting = written(by_unit(weighted.select(order)).mapInArrow(_meeting, kind), "jaccard-meeting")
    wanted = written(meeting.select("k").distinct().join(classes, "k").select("k", F.col("copy_id").alias("doc_id")), "jaccard-wanted")
    full = meeting.join(_sets(docs, wanted), "k").select(*order, "shingles")
    linked = written(by_unit(full).mapInArrow(_linking(threshold), LINKS), "jaccard-links")

    roots = groups_of(linked)
    degrees = linked.groupBy("k").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    grouped = roots.join(classes.select("k", "copy_id"), "k").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = roots.join(grouped, "root").join(degrees, "k", "left").select("k", "root", "class_id", "classes", "documents")
    known = classes.select("k", "copy_id", "n").join(per_class, "k", "left").select(
        "k", F.coalesce("root", "k").alias("root"), "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"),
        (F.col("n") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_text_links"),
    )
    return signed.select("k", "doc_id").join(known, "k").select("doc_id", "k", "root", "class_id", "copy_id", "n_links", "n_text_links")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, and of its repeated rows one. Where one id
    stands on several texts, each is a document of its own (within a group the smallest digest stays). Rows without an id all
    stay."""
    key, stay_id, stay_text = (free_name(docs, x) for x in ("_key", "_stay_id", "_stay_text"))
    stay = _links(docs, threshold).where("doc_id = class_id").groupBy("root").agg(F.min("doc_id").alias(stay_id), F.min("k").alias(stay_text))
    own = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    kept = own.join(stay, (own["doc_id"].cast("long") == F.col(stay_id)) & (own[key] == F.col(stay_text)), "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(docs.where("doc_id is null"))
