"""Keyed upserts, liveness, event folds and the other operators that carry state from one run to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A board with at least so many open postings, of which less than this share is listed, is not believed.
GUARD_MIN_OPEN, GUARD_MIN_SHARE = 5, 0.2
#: Misses in a row that close a posting; failed polls that kill a board; the drop that makes a poll suspect.
CLOSE_AFTER, DEAD_AFTER, SUSPECT_DROP, SUSPECT_FROM = 2, 3, 0.2, 10


def merge(base: DataFrame, delta: DataFrame, keys: list[str], version: str | None = None, update: list[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` put in by key. Of several delta rows of a key the newest version counts, and of equal
    versions the row with the largest hash, so that the choice is the same in every run; a stored
    row is only replaced by one whose version is not older. ``update``: columns to replace (all but the keys). One exchange
    by key on both sides; run twice it changes nothing."""
    if version is not None:
        newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc(F.xxhash64(*[c for c, kind in delta.dtypes if not kind.startswith("map")]))))
        delta = delta.withColumn("_nth", newest).where("_nth = 1").drop("_nth")
    change = [c for c in base.columns if c not in keys] if update is None else update
    old, new = base.withColumn("_stored", F.lit(True)).alias("o"), delta.withColumn("_given", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    stored, given = F.col("o._stored").isNotNull(), F.col("n._given").isNotNull()
    take = given if version is None else given & (~stored | F.col(f"o.{version}").isNull() | (F.col(f"n.{version}") >= F.col(f"o.{version}")))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.when(stored, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in change:
            out.append(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(stored, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(out)


def upsert_counts(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many delta keys are inserted and how many updated."""
    d = delta.select(*keys).distinct()
    found = d.join(base.select(*keys).withColumn("_stored", F.lit(True)).distinct(), keys, "left")
    return found.agg(F.count_if(F.col("_stored").isNull()).alias("inserted"), F.count_if(F.col("_stored").isNotNull()).alias("updated"))


def accumulate(stored: DataFrame, delta: DataFrame, keys: list[str], add: list[str], last: list[str]) -> DataFrame:
    """Upsert where the ``add`` columns grow by the delta's and the ``last`` ones are replaced."""
    o, n = stored.alias("o"), delta.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    total = lambda c: (F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))).alias(c)
    late = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return joined.select([*map(pick, keys), *map(total, add), *map(late, last)])


def pending(rows: DataFrame, stored_key: str, current_key: Column) -> DataFrame:
    """Rows whose stored version key is not the current one; a missing key is never current."""
    return rows.where(~F.col(stored_key).eqNullSafe(current_key))


def ids_hash(ids: Column) -> Column:
    """Digest of a set of ids that does not depend on their order: sorted, one per line."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(ids.cast("string"))), "\n"), F.lit("\n")), 256)


def liveness(postings: DataFrame, listed: DataFrame, board: str, item: str, polled: DataFrame | None = None) -> DataFrame:
    """One complete poll per board applied to its postings. ``postings``: board, item, status, missing_polls;
    ``listed``: (board, item) of what polls listed; ``polled``: the boards that were polled, of which some may have listed
    nothing (None: those that listed something). Boards without a poll stay as they are, and so do those
    whose list is too short to believe. Listed postings are open without misses; others miss once more and close at the
    second miss in a row. Adds ``suspect``."""
    seen = listed.select(board, item).distinct().withColumn("_listed", F.lit(True))
    boards = listed.select(board) if polled is None else listed.select(board).union(polled.select(board))
    polls = boards.distinct().withColumn("_polled", F.lit(True))
    rows = postings.join(seen, [board, item], "left")
    is_open = F.col("status") == "open"
    guard = rows.groupBy(board).agg(F.count_if(is_open).alias("_open"), F.count_if(is_open & F.col("_listed")).alias("_found"))
    guard = guard.withColumn("suspect", (F.col("_open") >= GUARD_MIN_OPEN) & (F.col("_found") < F.col("_open") * GUARD_MIN_SHARE))
    out = rows.join(guard.select(board, "suspect"), board, "left").join(polls, board, "left")
    acts = F.col("_polled").isNotNull() & ~F.col("suspect")
    missed = acts & F.col("_listed").isNull() & is_open
    here = acts & F.col("_listed").isNotNull() & F.col("status").isin("open", "closed")
    return out.select(
        *[c for c in postings.columns if c not in ("status", "missing_polls")],
        F.when(here, "open").when(missed & (F.col("missing_polls") + 1 >= CLOSE_AFTER), "closed").otherwise(F.col("status")).alias("status"),
        F.when(here, 0).when(missed, F.col("missing_polls") + 1).otherwise(F.col("missing_polls")).alias("missing_polls"),
        (F.col("_polled").isNotNull() & F.col("suspect")).alias("suspect"),
    )


def misses_over_polls(polls: DataFrame, seen: DataFrame, board: str, item: str, at: str) -> DataFrame:
    """A sequence of complete polls at once: for each board, item and poll since the item was first seen, how many polls
    in a row have missed it, and whether that closes it. A gaps-and-islands window instead of one pass per poll."""
    first = seen.groupBy(board, item).agg(F.min(at).alias("_first"))
    grid = first.join(polls.select(board, at).distinct(), board).where(F.col(at) >= F.col("_first"))
    marked = grid.join(seen.select(board, item, at).distinct().withColumn("_here", F.lit(1)), [board, item, at], "left")
    order = W.partitionBy(board, item).orderBy(at)
    island = marked.withColumn("_island", F.sum(F.coalesce("_here", F.lit(0))).over(order))
    runs = island.withColumn("missing_polls", F.sum(F.when(F.col("_here").isNull(), 1).otherwise(0)).over(W.partitionBy(board, item, "_island").orderBy(at)))
    return runs.select(board, item, at, F.col("missing_polls").cast("long").alias("missing_polls"), F.when(F.col("missing_polls") >= CLOSE_AFTER, "closed").otherwise("open").alias("status"))


def fold_polls(polls: DataFrame, board: str, item: str, at: str, stored: DataFrame | None = None) -> DataFrame:
    """A sequence of complete polls applied one after the other, guard included: (board, item, status, missing_polls, seen_at,
    closed_at, suspects) of every item that was ever listed or stored. ``polls``: (board, at, item), one row per listed item; a
    poll that lists nothing is a row with a null item. ``stored``: (board, item, status, missing_polls) before the first poll.
    ``suspects``: how many polls of the board were not believed.

    Whether a poll is believed depends on what earlier ones left, so no window can tell; a board's rows stream past in order
    through one task, which holds its items, and each believed poll looks only at what it and the two before it list. Work
    grows with the rows listed, not with items times polls. Listed twice is listed once; rows without a board or time are no polls."""
    kinds = dict(polls.dtypes)
    own = polls.select(F.col(board).alias("b"), F.col(at).alias("t"), F.col(item).alias("i"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("m")).where("b is not null and t is not null")
    if stored is not None:
        before = stored.select(F.col(board).alias("b"), F.lit(None).cast(kinds[at]).alias("t"), F.col(item).alias("i"), F.lit(0).alias("kind"), F.col("status").alias("s"), F.col("missing_polls").cast("long").alias("m"))
        own = before.where("b is not null").unionByName(own)

    def run(batches):
        import pyarrow as pa

        def flush(b, fold):
            return [(b, *r) for r in fold.rows()]

        out, now, fold, poll, listed = [], None, None, None, set()
        for batch in batches:
            for b, t, i, kind, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or b != now:
                    if fold is not None:
                        if poll is not None:
                            fold.take(poll, listed)
                        out += flush(now, fold)
                    now, fold, poll, listed = b, PollFold(), None, set()
                if kind == 0:
                    fold.store(i, s, m)
                    continue
                if t != poll:
                    if poll is not None:
                        fold.take(poll, listed)
                    poll, listed = t, set()
                if i is not None:
                    listed.add(i)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types, strict=True)], names=columns)
                out = []
        if fold is not None:
            if poll is not None:
                fold.take(poll, listed)
            out += flush(now, fold)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types, strict=True)], names=columns)

    from pyspark.sql.pandas.types import to_arrow_schema

    done = own.select(F.col("b").alias(board), F.col("i").alias(item), F.lit("").alias("status"), F.lit(0).cast("long").alias("missing_polls"), F.col("t").alias("seen_at"), F.col("t").alias("closed_at"), F.lit(0).cast("long").alias("suspects")).schema
    arrow = to_arrow_schema(done)
    columns, types = arrow.names, arrow.types
    return own.repartition("b").sortWithinPartitions("b", "kind", "t").mapInArrow(run, done)


class PollFold:
    """What a sequence of complete polls leaves of one board's items."""

    def __init__(self):
        self.polls, self.suspects, self.open = 0, 0, set()
        #: By item: the believed poll that listed it last (counted back by the misses it was stored with), its time, the time it closed.
        self.last: dict = {}
        self.seen: dict = {}
        self.closed: dict = {}
        self.other: dict = {}
        #: Items that may close at the next polls: by the poll that listed them last.
        self.due: dict[int, list] = {}

    def store(self, item, status: str, misses: int | None) -> None:
        if status not in ("open", "closed"):
            self.other[item] = (status, misses)
            return
        self.last[item] = -(misses or 0)
        if status == "open":
            self.open.add(item)
            self.due.setdefault(self.last[item], []).append(item)
        else:
            self.closed[item] = None

    def take(self, at, listed: set) -> None:
        listed = {i for i in listed if i not in self.other}
        found = len(listed & self.open)
        if len(self.open) >= GUARD_MIN_OPEN and found < len(self.open) * GUARD_MIN_SHARE:
            self.suspects += 1
            return
        self.polls += 1
        for i in listed:
            self.last[i], self.seen[i] = self.polls, at
            self.open.add(i)
            self.closed.pop(i, None)
        self.due[self.polls] = list(listed)
        for p in [p for p in self.due if p <= self.polls - CLOSE_AFTER]:
            for i in self.due.pop(p):
                if self.last[i] == p and i in self.open:
                    self.open.discard(i)
                    self.closed[i] = at

    def rows(self) -> list[tuple]:
        """(item, status, missing polls, last seen, closed at, suspect polls), by item."""
        misses = lambda i: self.polls - self.last[i] if i in self.open else CLOSE_AFTER if self.closed.get(i) is not None else -self.last[i]
        out = [(i, "open" if i in self.open else "closed", misses(i), self.seen.get(i), self.closed.get(i), self.suspects) for i in self.last]
        return sorted(out + [(i, s, m, None, None, self.suspects) for i, (s, m) in self.other.items()], key=lambda r: str(r[0]))


def next_board_status(ok: Column, blocked: Column, dead: Column, failures: Column, status: Column) -> Column:
    """A board's status after a poll; ``failures``: those in a row before it."""
    return F.when(ok, "active").when(blocked, "blocked").when(dead & (failures + 1 >= DEAD_AFTER), "dead").otherwise(status)


def suspect_drop(count: Column, before: Column) -> Column:
    return (before >= SUSPECT_FROM) & (count < before * SUSPECT_DROP)


def next_link_state(dead_checks: Column, http_status: Column) -> tuple[Column, Column]:
    """(dead checks, dead) after a link check: 404 and 410 count, twice is dead; 2xx and 3xx reset; others change nothing."""
    gone, good = http_status.isin(404, 410), http_status.between(200, 399)
    checks = F.when(gone, dead_checks + 1).when(good, 0).otherwise(dead_checks)
    return checks, checks >= 2


def current_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Last state of each key, and how often the state really changed; moves to the state one is in are no changes."""
    by = W.partitionBy(key).orderBy(*order)
    moved = events.withColumn("_before", F.lag(state).over(by))
    return moved.groupBy(key).agg(
        F.max_by(state, F.struct(*order)).alias("state"), F.count_if(~F.col(state).eqNullSafe(F.col("_before"))).alias("transitions"), F.max(order[0]).alias("since")
    )


def dedupe_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event per key, the one with the smallest id: later copies were never written."""
    return events.dropDuplicates(keys) if "event_id" not in events.columns else events.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("event_id"))).where("_nth = 1").drop("_nth")


def erase(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` without those of the owners: deletion as an anti join."""
    return rows.join(owners.select(key).distinct(), key, "left_anti")


def newest_copy(rows: DataFrame, same: list[str], item: str, hides: Column, exempt: Column) -> DataFrame:
    """``rows`` without those that have a newer identical copy: same values (nulls alike) in ``same``, a larger ``item``, and
    ``hides`` true for the copy. Rows that are ``exempt`` always stay. One window instead of a self-join."""
    newest = F.max(F.when(hides, F.col(item))).over(W.partitionBy(*same))
    return rows.withColumn("_newest", newest).where(exempt | F.col("_newest").isNull() | (F.col(item) >= F.col("_newest"))).drop("_newest")


def newest_copy_by_join(rows: DataFrame, same: list[str], item: str, hides: Column, exempt: Column) -> DataFrame:
    """The same as an anti join on null-safe keys, for tables bucketed by a key of ``same``."""
    p, q = rows.alias("p"), rows.where(hides).alias("q")
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in same] + [F.col(f"q.{item}") > F.col(f"p.{item}")]
    return p.where(~exempt).join(q, on, "left_anti").union(rows.where(exempt))
