"""Operator 7: mixing sources to target weights by soft domain membership.

A classifier trained on the labelled rows gives each document posteriors over domains (clean, low quality, toxic). Its
features are log-odds of hashed words and word shapes for each domain against the others, from counts summed over all
labelled rows of the training split, where odds that are not significant count as none; a small multinomial regression
over a text's sum and its largest word of each domain is fitted on at most ``CALIBRATION_ROWS`` rows of the other split. Rates of
documents, between 0 and ``max_rate``, are then fitted so that the expected tokens of each domain, sum of
rate * tokens * posterior, match their targets: least squares of the relative misses by projected gradient steps. A step is
preconditioned by the Gram matrix of the documents whose rates are not at a bound; where that leads no nearer, halves of it
and then the plain gradient step, which always descends, are tried. Each step is one distributed sum of a few numbers, added up as whole
1024ths of a token, so that the order of tasks does not matter; a document's rate follows from its posteriors and the steps
so far, so no state is kept by document. Rates become whole copies by a fixed hash of the id. ``Fitted`` says what was reached;
targets that no rates can meet end at the nearest totals, with a warning.

Defined cases: a null text is empty and has no tokens, its posteriors are the priors; rows are rated one by one, so
repeated rows and ids stay; a null id has a hash of its own; labels with nulls are left out; other columns pass through
where rows are kept. Without labels all domains are equally likely. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import byte_slices, maybe_broadcast, mixed, small_batches, space_table, text_bytes, words_in, written

DOMAINS = ("clean", "low", "toxic")
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 10
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: What the regression reads of a text, by domain: the sum of its log-odds over the root of its words, and the largest of a word.
FEATURES = 2 * len(DOMAINS)
#: Labelled rows that the temperature and biases are fitted on at most, the ones with the smallest hash of their id.
CALIBRATION_ROWS = 20_000
#: Standard errors that a bucket's log-odds must lie from zero to count.
SIGNIFICANT = 4.5
#: Tokens are added up as whole numbers of this many parts.
PARTS = 1024
#: Of 10 labelled rows, so many train the counts; the others calibrate.
TRAIN_TENTHS = 8


@dataclass(frozen=True)
class Mix:
    """Targets by domain: ``weights``, shares of ``total`` tokens (None: as many as there are), or else ``factors``, multiples
    of the domain's expected tokens; ``max_rate``: copies at most; ``tolerance``: relative miss that counts as met;
    ``most_steps``: passes over the scores at most."""

    weights: dict[str, float] | None = None
    total: float | None = None
    factors: dict[str, float] = field(default_factory=lambda: {"clean": 1.0, "low": 0.5, "toxic": 0.25})
    max_rate: float = 4.0
    tolerance: float = 1e-4
    most_steps: int = 60


def _byte_classes() -> np.ndarray:
    """Lower case, upper case, digit, beyond ASCII, other."""
    out = np.full(256, 4, np.uint8)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:] = 0, 1, 2, 3
    return out


def tokens_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets and text numbers of the words of an Arrow text column. A shape is the classes of a
    word's first, middle and last byte and its length up to 7."""
    data, offsets = text_bytes(column)
    starts, ends, hashes, text = words_in(data, offsets, space_table())
    kind = _byte_classes()[data]
    size = np.minimum(ends - starts, 7)
    shape = ((kind[starts].astype(np.int64) * 5 + kind[(starts + ends) // 2]) * 5 + kind[ends - 1]) * 8 + size if len(starts) else np.zeros(0, np.int64)
    return (hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), WORD_BUCKETS + shape % SHAPE_BUCKETS, text


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number) of labels without nulls; of several labels of one id the worst."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).cast("int").alias("domain"))


def _split(df: DataFrame) -> DataFrame:
    return df.withColumn("train", F.pmod(F.xxhash64("doc_id"), F.lit(10)) < TRAIN_TENTHS)


def word_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """[BUCKETS, domains] log-odds of each domain against the others, from counts summed over the training split of all labelled rows. What comes
    to the driver is the model, whose size does not depend on the data."""
    own = _split(labels).where("train").select("doc_id", "domain")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(maybe_broadcast(own), "doc_id").select("domain", "text")

    def count(batches):
        import pyarrow as pa

        total = np.zeros((len(DOMAINS), BUCKETS), np.int64)
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words, shapes, text = tokens_of(part.column(1))
                domain = part.column(0).to_numpy()[text]
                for d in range(len(DOMAINS)):
                    mine = domain == d
                    total[d] += np.bincount(words[mine], minlength=BUCKETS) + np.bincount(shapes[mine], minlength=BUCKETS)
        d, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[d, at])], names=["domain", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(DOMAINS)))
    for r in rows.mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket, r.domain] = r.n
    return log_odds(counts)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket by domain, one half added to each count; zero where they are not significant."""
    out = np.zeros_like(counts)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        own = counts[part] + 0.5
        rest = own.sum(1, keepdims=True) - own
        odds = np.log(own / own.sum(0)) - np.log(rest / rest.sum(0))
        out[part] = np.where(np.abs(odds) > SIGNIFICANT * np.sqrt(1 / own + 1 / rest), odds, 0.0)
    return out


def scores_of(column, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text of an Arrow column, and its ``FEATURES``. One telling word counts in a long text as in a short one."""
    words, shapes, text = tokens_of(column)
    n, k = np.bincount(text, minlength=len(column)), len(DOMAINS)
    z, full = np.zeros((len(column), FEATURES)), np.flatnonzero(n)
    if len(full):
        odds, begin = weights[words] + weights[shapes], (np.cumsum(n) - n)[full]
        z[full, :k] = np.add.reduceat(odds, begin, axis=0) / np.sqrt(n[full])[:, None]
        z[full, k:] = np.maximum.reduceat(odds, begin, axis=0)
    return n, z


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, _tokens, _z) of the rows (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n, z = scores_of(part.column(1), weights)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), lists], names=["doc_id", "_tokens", "_z"])

    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, _tokens long, _z array<double>")


def calibrate(z: np.ndarray, domain: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and biases of softmax(z @ slopes + bias) by gradient descent on the log loss; the sums themselves if there
    is next to nothing to fit on."""
    k = len(DOMAINS)
    slopes, bias = np.eye(FEATURES, k), np.zeros(k)
    if len(z) < 30:
        return slopes, bias
    spread = np.maximum(z.std(0), 1e-9)
    x, y = np.clip(z / spread, -8, 8), np.eye(k)[domain]
    speed_s, speed_b = np.zeros((FEATURES, k)), np.zeros(k)
    for _ in range(steps):
        error = (softmax(x @ slopes + bias) - y) / len(x)
        speed_s = 0.9 * speed_s + x.T @ error + 1e-4 * slopes
        speed_b = 0.9 * speed_b + error.sum(0)
        slopes, bias = slopes - 0.2 * speed_s, bias - 0.2 * speed_b
    return slopes / spread[:, None], bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Fitted:
    """The classifier and the steps of the fit: a document's rate follows from them and its posteriors."""

    weights: np.ndarray
    slopes: np.ndarray
    bias: np.ndarray
    steps: np.ndarray
    max_rate: float
    #: Expected tokens by domain: as they are, as wanted, and as the rates give them; and whether that is within the tolerance.
    natural: np.ndarray | None = None
    want: np.ndarray | None = None
    got: np.ndarray | None = None
    met: bool = False

    def posteriors(self, z: np.ndarray) -> np.ndarray:
        return softmax(z @ self.slopes + self.bias)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return rates_after(p, self.steps, self.max_rate)


def rates_after(p: np.ndarray, steps: np.ndarray, max_rate: float) -> np.ndarray:
    """Rates start at 1 (or the cap), and each step subtracts its gradient and projects onto [0, max_rate]."""
    r = np.full(len(p), min(1.0, max_rate))
    for g in steps:
        r = np.clip(r - p @ g, 0.0, max_rate)
    return r


def _z_of(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> tuple[Fitted, DataFrame]:
    """The fitted mix, and the written table of (doc_id, _tokens, _z) that it was fitted on."""
    known = written(labelled(labels), "mixing-labels")
    weights = word_weights(docs, known)
    scored = written(score(docs, weights), "mixing-scores")
    held = _split(known).where("not train").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS).select("doc_id", "domain")
    # One row for each held id, however often it occurs: CALIBRATION_ROWS at most.
    once = scored.join(maybe_broadcast(written(held, "mixing-held")), "doc_id").groupBy("doc_id", "domain").agg(F.min(F.struct("_tokens", "_z")).alias("x"))
    rows = once.orderBy("doc_id").select("domain", "x._z").collect()
    slopes, bias = calibrate(np.array([r._z for r in rows]).reshape(-1, FEATURES), np.array([r.domain for r in rows], np.int64))
    fitted = Fitted(weights, slopes, bias, np.zeros((0, len(DOMAINS))), mix.max_rate)

    k = len(DOMAINS)

    def totals(steps: np.ndarray, rated: bool) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain under the rates after ``steps``, and the Gram matrix of the posteriors of documents
        whose rate is not at a bound, weighted by tokens; a few sums from each task."""

        def run(batches):
            import pyarrow as pa

            total = np.zeros(k + k * k, np.int64)
            for batch in batches:
                if batch.num_rows:
                    p, t = fitted.posteriors(_z_of(batch.column(1))), batch.column(0).to_numpy().astype(float)
                    r = rates_after(p, steps, mix.max_rate) if rated else np.ones(len(p))
                    # At a bound a rate counts as free if the last step pulls it back.
                    pull = p @ steps[-1] if len(steps) else np.zeros(len(p))
                    free = t * ((r > 0) & (r < mix.max_rate) | (r > 0) & (pull > 0) | (r <= 0) & (pull < 0)) if len(steps) else t
                    parts = np.concatenate([(t * r)[:, None] * p, (free[:, None, None] * p[:, :, None] * p[:, None, :]).reshape(-1, k * k)], 1)
                    total += np.rint(parts * PARTS).astype(np.int64).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "total"])

        sums = scored.select("_tokens", "_z").mapInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total"))
        out = np.zeros(k + k * k)
        for row in sums.collect():
            out[row["at"]] = row["total"] / PARTS
        return out[:k], out[k:].reshape(k, k)

    natural, _ = totals(fitted.steps, False)
    if mix.weights is not None:
        want = np.array([mix.weights.get(d, 0.0) for d in DOMAINS]) / sum(mix.weights.values()) * (natural.sum() if mix.total is None else mix.total)
    else:
        want = natural * np.array([mix.factors.get(d, 1.0) for d in DOMAINS])
    steps, got = descend(totals, natural, want, mix)
    met = bool((np.abs(got - want) <= mix.tolerance * scale_of(natural, want)).all())
    if not met:
        warnings.warn(f"the mix was not met: wanted {dict(zip(DOMAINS, want.tolist(), strict=True))} tokens, got {dict(zip(DOMAINS, got.tolist(), strict=True))}", stacklevel=2)
    return Fitted(weights, slopes, bias, steps, mix.max_rate, natural, want, got, met), scored


def scale_of(natural: np.ndarray, want: np.ndarray) -> np.ndarray:
    """What misses are measured against, by domain."""
    return np.maximum(np.maximum(natural, want), 1.0)


def descend(totals: Callable, natural: np.ndarray, want: np.ndarray, mix: Mix) -> tuple[np.ndarray, np.ndarray]:
    """Steps that lead the rates to the targets, and the totals reached. ``totals(steps, True)``: expected tokens under the rates
    after the steps, and the Gram matrix of the documents that are free to move."""
    k, scale = len(DOMAINS), scale_of(natural, want)
    loss = lambda got: float((((got - want) / scale) ** 2).sum())
    steps = np.zeros((0, k))
    got, gram = totals(steps, True)
    whole, passes = gram, 1  # before the first step every document is free
    # Gradients in the metric of the documents' tokens; below one over its curvature a step always descends.
    plain = 1 / max(float(np.linalg.eigvalsh(whole / np.outer(scale, scale)).max()), 1e-12)
    while passes < mix.most_steps and (np.abs(got - want) > mix.tolerance * scale).any():
        miss = got - want
        newton = np.linalg.solve(gram + np.diag(1e-6 * scale), miss)
        for step in (newton, newton / 2, newton / 8, plain * miss / scale**2):
            trial = np.vstack([steps, step])
            found, free = totals(trial, True)
            passes += 1
            if loss(found) < (1 - 1e-4) * loss(got):
                steps, got, gram = trial, found, free
                break
        else:
            break  # no step leads nearer: these are the nearest totals
    return steps, got


def copies_of(ids, r: np.ndarray) -> np.ndarray:
    """Whole copies for rates: rounded down or up by a fixed hash of the id, so that they are right on average."""
    import pyarrow as pa

    key = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
    with np.errstate(over="ignore"):
        u = (mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.floor(r + u).astype(np.int64)


def rate(scored: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies) of the rows (doc_id, _tokens, _z)."""
    names = ["doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = fitted.posteriors(_z_of(batch.column(2))) if batch.num_rows else np.zeros((0, len(DOMAINS)))
            r = fitted.rates(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p[:, d]) for d in range(len(DOMAINS))], pa.array(r), pa.array(copies_of(batch.column(0), r))], names=names)

    return scored.mapInArrow(run, f"doc_id long, n_tokens long, {', '.join(f'p_{d} double' for d in DOMAINS)}, rate double, copies long")


def report(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Tokens, posteriors, rate and copies per row of ``docs``."""
    fitted, scored = fit(docs, labels, mix)
    return rate(scored, fitted)


def summary(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(domain, tokens, target, expected, met): what a fit wanted and what it reached."""
    rows = [(d, *(float(x[i]) for x in (fitted.natural, fitted.want, fitted.got)), fitted.met) for i, d in enumerate(DOMAINS)]
    return spark.createDataFrame(rows, "domain string, tokens double, target double, expected double, met boolean")


def sample(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with each row as often as its copies say. Texts are scored again, and rows repeated, in one narrow pass,
    rather than shuffled."""
    fitted, _ = fit(docs, labels, mix)
    at, ids = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in byte_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                _, z = scores_of(part.column(at), fitted.weights)
                copies = copies_of(part.column(ids), fitted.rates(fitted.posteriors(z)))
                yield part.take(pa.array(np.repeat(np.arange(part.num_rows), copies)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
