"""Operator 2: approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by a hash, within bands of like norms. Each shard builds its graph in batches: greedy searches on
the graph so far propose neighbours, and relaxed distance pruning (an edge to c goes if a kept neighbour is closer to c by the
factor ``ALPHA``) keeps diverse ones, for new points and, where reverse edges overflow, for old ones. Queries run a beam search
on every shard; their candidates are scored exactly, in double precision on the original vectors, and merged.

Nearness is the largest inner product. Graphs are built on vectors with one more component, sqrt(M^2 - |x|^2) with M the
shard's largest norm, where the nearest by distance are those of largest inner product. In a band norms differ by the factor
2^``BAND`` at most, and a shard is scaled by a power of two, so single precision tells points apart whatever norms other
vectors have. Searches enter at points that lie far from each other (so no cluster is out of sight) and at one point of
each part that edges don't reach, so a beam ends full or with all of its shard: a query gets k rows, or all candidates.

Defined cases: null, zero and non-finite vectors, vectors with null components, vectors with null ids and vectors whose
length is not the most common one take no part; equal vectors are one point of the graph that lists their 21 smallest ids
(no query can return more of them, its own left out), so copies need no cap elsewhere; repeated rows count once; a query id
with several vectors uses the smallest; ties in score go to the smaller id. Without queries or candidates there are no rows.
Every vector is indexed: nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomfield.llm.common import written

K = 20
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 256, 1.2
#: Nodes that a beam expands per step.
WIDE = 4
#: Powers of two that the norms of a shard may span, and points far from each other at which searches enter.
BAND, ENTRIES = 4, 48
#: Shards hold at most ``MOST`` vectors, of which recall was measured (see README), and ``SHARD_BYTES``; few vectors are still
#: split into up to ``FEW`` shards of ``LEAST`` or more, so that several tasks work.
MOST, SHARD_BYTES, LEAST, FEW = 65_536, 256 << 20, 4096, 12


def shards_for(n: int, dim: int) -> int:
    """Shards for n vectors. A task holds for each vector two copies in double and two in single precision, and its edges twice."""
    most = max(1, min(MOST, SHARD_BYTES // (24 * (dim + 1) + 8 * DEGREE)))
    return max(-(-n // most), min(FEW, -(-n // LEAST)))


def bands_of(exponents: list[int]) -> dict[int, int]:
    """A band for each exponent of a norm: from the largest down, ``BAND`` of them share one."""
    out, top = {}, None
    for e in sorted(exponents, reverse=True):
        top = e if top is None or e <= top - BAND else top
        out[e] = top
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = own.where("vec_id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good


class Graph:
    """The graph of one shard. ``x``: points with the added component, as float32."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        self.x, self.n = x, len(x)
        self.square = (x * x).sum(1)
        self.edges = np.full((self.n, DEGREE), -1, np.int32) if edges is None else edges
        self.starts = self._far_apart()
        if edges is not None:
            self._enter_all()

    def _far_apart(self) -> np.ndarray:
        """The point nearest to the mean, then always the one farthest from those before, as long as it lies elsewhere."""
        out = [int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())]
        nearest = np.full(self.n, np.inf, np.float32)
        while len(out) < min(ENTRIES, self.n):
            nearest = np.minimum(nearest, ((self.x - self.x[out[-1]]) ** 2).sum(1))
            if not nearest[far := int(nearest.argmax())] > 0:
                break
            out.append(far)
        return np.array(out)

    def _enter_all(self) -> None:
        """Add the first point of each part that edges from the entries don't reach."""
        reached, front, at = np.zeros(self.n, bool), self.starts, 0
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(self.edges[front])
                near = near[near >= 0]
                front = near[~reached[near]]
            rest = np.flatnonzero(~reached[at:])
            if not len(rest):
                return
            at += int(rest[0])
            front = np.array([at])
            self.starts = np.append(self.starts, at)

    def search(self, q: np.ndarray, beam: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the nearest found of each query row, ascending; -1 and inf fill up."""
        m = len(q)
        beam = min(beam, self.n)
        ids, dist = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, self.n), bool)
        own = (q * q).sum(1)
        starts = self.starts if starts is None else starts
        seen[:, starts] = True
        first = self.square[starts] - 2 * q @ self.x[starts].T + own[:, None]
        order = np.argsort(first, axis=1, kind="stable")[:, :beam]
        ids[:, : order.shape[1]], dist[:, : order.shape[1]] = starts[order], np.take_along_axis(first, order, 1)
        rows = np.arange(m)
        while len(rows):
            open_ = ~done[rows] & (ids[rows] >= 0)
            some = open_.any(1)
            rows, open_ = rows[some], open_[some]
            if not len(rows):
                break
            # The nearest unexpanded nodes: beams are sorted, so these are the first ones.
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :WIDE]
            real = np.take_along_axis(open_, pick, 1)
            done[rows[:, None], pick] |= real
            near = np.where(real[:, :, None], self.edges[np.where(real, ids[rows[:, None], pick], 0)], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            node = near[r, c]
            seen[rows[r], node] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = self.square[node] - 2 * np.einsum("ij,ij->i", self.x[node], q[rows[r]]) + own[rows[r]]
            all_d = np.concatenate([dist[rows], d], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows] = np.take_along_axis(all_d, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, near, -1)], 1), order, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(near.shape, bool)], 1), order, 1)
        return ids, dist

    def prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Edges of the points ``p`` chosen from their candidate rows (-1: none), nearest first."""
        cand = np.where(cand == p[:, None], -1, cand)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        points = self.x[np.maximum(cand, 0)]
        d = ((points - self.x[p][:, None]) ** 2).sum(2)
        d[cand < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        cand, d, points = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(points, order[:, :, None], 1)
        square = (points * points).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        alive, rows = np.isfinite(d), np.arange(len(p))
        out = np.full((len(p), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            pick = alive.argmax(1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, k] = cand[rows[ok], pick[ok]]
            alive &= ~(ok[:, None] & (ALPHA * ALPHA * between[rows, pick] <= d))
            alive[rows, pick] = False
        return out

    def build(self, seed: int = 7) -> None:
        order = np.random.default_rng(seed).permutation(self.n)
        order = np.concatenate([self.starts, order[~np.isin(order, self.starts)]])
        at = 1
        while at < self.n:
            # At most a sixteenth of what stands, so that searches see nearly all points that came before.
            size = min(self.n - at, max(1, at // 16), max(16, min(256, (1 << 26) // self.n)))
            batch = order[at : at + size]
            found, _ = self.search(self.x[batch], BUILD_BEAM, self.starts[: max(1, min(at, len(self.starts)))])
            self.edges[batch] = self.prune(batch, found)
            self._back(batch)
            at += size
        self._enter_all()

    def _back(self, batch: np.ndarray) -> None:
        """Reverse edges of new points; rows that overflow are pruned."""
        out = self.edges[batch]
        to, source = out.ravel(), np.repeat(batch, DEGREE)
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        free = (self.edges[targets] < 0).sum(1)
        roomy = count <= free
        for k in np.flatnonzero(roomy):
            filled = DEGREE - free[k]
            self.edges[targets[k], filled : filled + count[k]] = source[first[k] : first[k] + count[k]]
        over = np.flatnonzero(~roomy)
        over, lo = over[np.argsort(count[over], kind="stable")], 0
        while lo < len(over):  # rows of like length together, so many that their distances fit into memory
            size = max(1, min(256, (1 << 22) // (DEGREE + int(count[over[min(lo + 255, len(over) - 1)]])) ** 2))
            part, lo = over[lo : lo + size], lo + size
            wide = int(count[part].max())
            cand = np.full((len(part), DEGREE + wide), -1, np.int64)
            cand[:, :DEGREE] = self.edges[targets[part]]
            for i, k in enumerate(part):
                cand[i, DEGREE : DEGREE + count[k]] = source[first[k] : first[k] + count[k]]
            self.edges[targets[part]] = self.prune(targets[part], cand)


def raised(v: np.ndarray) -> np.ndarray:
    """Points, scaled by a power of two, with the component that turns inner products into distances."""
    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
    square = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(square.max() - square)[:, None]], 1).astype(np.float32)


def directions(q: np.ndarray) -> np.ndarray:
    """Queries, scaled to norm 1 (no order among inner products changes), with the added component 0."""
    q = np.ldexp(q, -np.frexp(np.abs(q).max(1))[1][:, None])
    return np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)


def _runs(batches, key: int) -> Iterator[tuple[bool, object]]:
    """(whether a new shard starts, batch of one shard) from batches sorted by shard."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(shard[a]) != last, batch.slice(a, b - a)
            last = int(shard[a])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(points: DataFrame, shards: int) -> DataFrame:
    """(shard, pos, v, ids, edges): the graphs of all shards. ``points``: (shard, v, ids)."""
    schema = "shard int, pos int, v array<double>, ids array<long>, edges array<int>"

    def finish(parts):
        import pyarrow as pa

        t = pa.Table.from_batches(parts).combine_chunks()
        g = Graph(raised(_matrix(t["v"].combine_chunks())))
        g.build()
        lists = pa.FixedSizeListArray.from_arrays(pa.array(g.edges.ravel()), DEGREE).cast(pa.list_(pa.int32()))
        out = pa.table({"shard": t["shard"], "pos": pa.array(np.arange(g.n, dtype=np.int32)), "v": t["v"], "ids": t["ids"], "edges": lists})
        yield from out.to_batches(max_chunksize=4096)

    def run(batches):
        held: list = []
        for new, batch in _runs(batches, 0):
            if new and held:
                yield from finish(held)
                held = []
            held.append(batch)
        if held:
            yield from finish(held)

    dealt = points.select("shard", "v", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("ids")[0])
    return dealt.mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, shards: int, k: int = K) -> DataFrame:
    """(query_id, vec_id, score): the k best of each shard for each query. A task holds one shard; its queries stream
    past in batches. ``queries``: (query_id, v)."""
    schema = "query_id long, vec_id long, score double"
    none = lambda kind: F.lit(None).cast(kind)
    left = index.select("shard", F.lit(0).alias("kind"), "pos", "v", "ids", "edges", none("long").alias("query_id"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), none("int").alias("pos"), "v", none("array<long>").alias("ids"), none("array<int>").alias("edges"), "query_id")

    def run(batches):
        import pyarrow as pa

        parts: list = []
        graph = vectors = ids = None

        def answer(batch):
            q = _matrix(batch.column(3))
            mine = batch.column(6).to_numpy()
            step = max(16, min(256, (1 << 26) // graph.n))
            for a in range(0, len(q), step):
                own, who = q[a : a + step], mine[a : a + step]
                found, _ = graph.search(directions(own), max(SEARCH_BEAM, k + 1))
                out = []
                for i in range(len(own)):
                    at = found[i][found[i] >= 0]
                    scores = (vectors[at] * own[i]).sum(1)
                    rows = [(-s, v) for s, p in zip(scores.tolist(), at.tolist(), strict=True) for v in ids[p] if v != who[i]]
                    rows.sort()
                    out += [(int(who[i]), v, -s) for s, v in rows[:k]]
                c = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for new, batch in _runs(batches, 0):
            if new:
                parts, graph = [], None
            kinds = batch.column(1).to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                parts.append(batch.slice(0, cut))
            if cut < batch.num_rows and parts:
                if graph is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    vectors, ids = _matrix(t["v"].combine_chunks()), t["ids"].to_pylist()
                    graph = Graph(raised(vectors), _matrix(t["edges"].combine_chunks()))
                    parts = [parts[0].slice(0, 1)]
                yield from answer(batch.slice(cut))

    both = left.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "pos")
    return both.mapInArrow(run, schema)


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``every``."""
    # The norm, without squares that leave the range of doubles.
    most = F.array_max(F.transform("v", F.abs))
    norm = most * F.sqrt(F.aggregate(F.transform("v", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))
    good = usable(vectors).withColumn("exponent", F.floor(F.log2(norm)).cast("int"))
    sizes = good.groupBy(F.size("v").alias("dim"), "exponent").count().collect()  # doubles have 2 100 exponents
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], result)
    total: dict[int, int] = {}
    for r in sizes:
        total[r["dim"]] = total.get(r["dim"], 0) + r["count"]
    dim = min(total, key=lambda d: (-total[d], d))
    band = bands_of([r["exponent"] for r in sizes if r["dim"] == dim])
    rows = {b: sum(r["count"] for r in sizes if r["dim"] == dim and band[r["exponent"]] == b) for b in band.values()}
    first, parts, shards = {}, {}, 0
    for b in sorted(rows):
        first[b], parts[b] = shards, shards_for(rows[b], dim)
        shards += parts[b]
    own = good.where(F.size("v") == dim)
    copies = own.withColumn("copy", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    points = copies.groupBy("v", "exponent").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for e, b in band.items() for x in (e, table[b])]), F.col("exponent"))
    dealt = points.withColumn("shard", (of(first) + F.pmod(F.xxhash64("v"), of(parts))).cast("int"))
    index = written(build(dealt, shards), "graph-index")
    asked = own.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    found = search(index, asked, shards, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
