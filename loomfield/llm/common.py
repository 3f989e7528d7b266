"""What several operators of this subpackage share: shared tables, word hashes of Arrow text columns, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only where its rows times their width are counted to be less; beyond it both sides shuffle.
BROADCAST_BYTES = 16 << 20
#: The separators of op5's words, and of the shingles: space, and tab to carriage return.
SPACES = (0x20, *range(0x09, 0x0E))


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only where it is unset and all runs in one process
    (tests), a temporary folder stands in for it; on a cluster an unset one is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return known.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column of ``df`` has it (in either case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts its lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(table: DataFrame) -> int:
    """Rows times width of a written table, as memory holds it: 16 bytes a row and column, and the lengths of what varies."""
    width = F.lit(16 * len(table.columns))
    for field in table.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        size = F.octet_length(c) if kind in ("string", "binary") else 2 * F.octet_length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(0)
        width = width + F.coalesce(size, F.lit(0))
    return int(table.agg(F.sum(width.cast("long"))).first()[0] or 0)


def maybe_broadcast(table: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint only if its rows times width are below ``BROADCAST_BYTES``, else with one for a
    join in which both sides shuffle; the rows are the same."""
    return F.broadcast(table) if table_bytes(table) <= BROADCAST_BYTES else table.hint("merge")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold the session's Arrow batches to so many rows: whole texts make the usual 10 000 too large for small executors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII string, bit by bit: DuckDB has no function for it."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: {byte}))"


# --- words of Arrow text columns, as arrays -------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """The first n powers of the odd multiplier and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _P))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse))])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def byte_slices(column, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow text column of about ``most`` bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with all texts of an Arrow column (null: empty), and len + 1 offsets into it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def words_in(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, 64-bit hashes and text numbers of the words in a buffer; a word is a run of ``is_word`` bytes that
    ends at its text's end. Equal words have equal hashes everywhere. Works in pieces, so memory stays a few times
    the buffer."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    mask = is_word[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = inner[inner > 0] - 1
    last[inner] = mask[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, done = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            a = starts[done]
            upto = max(done + 1, int(np.searchsorted(ends, a + piece, side="right")))
            z = ends[upto - 1]
            _grow(int(z - a) + 1)
            sums = np.zeros(z - a + 1, np.uint64)
            np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * _powers[: z - a], out=sums[1:])
            s, e = starts[done:upto] - a, ends[done:upto] - a
            hashes[done:upto] = mixed((sums[e] - sums[s]) * _inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            done = upto
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def space_table() -> np.ndarray:
    """Which bytes belong to words that are runs of anything but ``SPACES``."""
    out = np.ones(256, bool)
    out[list(SPACES)] = False
    return out


def shingles(hashes: np.ndarray, text: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words within a text, and their text numbers."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mixed(h * np.uint64(0x9FB21C651E98DF25) + hashes[k : n + k])
    own = text[:n] == text[width - 1 :]
    return h[own], text[:n][own]
