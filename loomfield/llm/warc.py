"""Operator 10: WARC archives, written and read back with boundary-chain verification.

Writing: each page becomes one WARC/1.1 record, built as a string column and written by Spark's text writer with the
record end as its line separator, which gives plain ``.warc`` bytes. Among equal payloads of at least ``REVISIT_BYTES``
the smallest page_id is the response and the others are revisits that refer to it.

Reading: tasks look for the magic in the archives' bytes and emit each candidate with the offset of its successor, which
its own Content-Length gives. A payload may hold the magic too, so candidates are not records yet. Pointer jumping from
the start of each file (successor links are squared until nothing new is reached) keeps only the candidates on the chain
of true boundaries. A chain that does not lead to the end of its file is an error.

Defined cases: null html is an empty payload; a null or blank url is written as an empty target; rows with the same
smallest page_id are all responses; a page without id is a response unless a page with an id has its payload; repeated
rows give repeated records; other columns are not read. An empty table gives no rows. A record is held whole by a task,
as is an archive: at most ``RECORDS_PER_ARCHIVE`` records and ``ARCHIVE_BYTES``, or one larger record.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import maybe_broadcast, shared_folder, written

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 2048
ARCHIVE_BYTES = 1 << 26
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _size_class() -> Column:
    """0 for pages of which ``RECORDS_PER_ARCHIVE`` records surely fit into ``ARCHIVE_BYTES``; each class above may be twice as
    large. An escaped url takes three times its bytes at most, and the rest of the headers less than 1024."""
    most = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("long") + 3 * F.octet_length(F.coalesce(F.col("url").cast("string"), F.lit(""))).cast("long") + 1024
    return F.greatest(F.lit(0), F.ceil(F.log2(most * RECORDS_PER_ARCHIVE / ARCHIVE_BYTES))).cast("int")


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string column ``value``: the record of each page, without the record end. Pages are not shuffled while the table
    of repeated payloads is small; beyond the size checked in ``maybe_broadcast`` both sides are joined by digest."""
    return _records(pages, date).select("value")


def _records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``records`` with the size class of each page as ``size_class``."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        _size_class().alias("size_class"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    size = F.octet_length("html")
    counted = own.where(size >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = written(counted.where("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first"), "warc-repeated")
    joined = own.join(maybe_broadcast(repeated), F.col("digest") == F.col("_digest"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(size)
    value = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        block,
    )
    return joined.select(value.alias("value"), "size_class")


def write(pages: DataFrame, folder: str) -> None:
    """Write the pages as archives of at most ``RECORDS_PER_ARCHIVE`` records and ``ARCHIVE_BYTES`` (or one larger record) into
    ``folder``. Records of each size class go to archives of their own, with half as many in each class above."""
    found = sorted(r[0] for r in pages.select(_size_class()).distinct().collect())
    rows = _records(pages)
    for n, k in enumerate(found or [0]):
        own = rows if len(found) < 2 else rows.where(F.col("size_class") == k)
        out = own.select("value").write.option("lineSep", END).option("maxRecordsPerFile", max(1, RECORDS_PER_ARCHIVE >> k))
        out.mode("append" if n else "error").text(folder)


class Headers:
    """Candidates' headers, asked for at ascending offsets. Candidates within one header share its end and its lines, so each
    byte is searched and each line is read once, however many there are."""

    def __init__(self, data: bytes):
        self.data, self.head, self.valid_from = data, -1, 0
        self.last: dict[str, tuple[int, str]] = {}

    def at(self, first: int) -> tuple[int, dict[str, str]] | None:
        """Where the header whose lines start at ``first`` ends, and its fields; None if it is none."""
        if self.head is not None and self.head < first:
            self._next(first)
        if self.head is None or first < self.valid_from:
            return None
        return self.head, {k: v for k, (where, v) in self.last.items() if where >= first}

    def _next(self, first: int) -> None:
        found = self.data.find(END.encode(), first)
        self.head, self.valid_from, self.last = found if found >= 0 else None, first, {}
        stop = found
        while stop >= first:  # lines from the last one back; one without a colon ends the header of all in front of it
            cut = self.data.rfind(b"\r\n", first, stop)
            start = cut + 2 if cut >= 0 else first
            key, colon, value = self.data[start:stop].partition(b": ")
            if not colon:
                self.valid_from = stop + 1
                return
            self.last.setdefault(key.decode("latin-1").lower(), (start, value.decode("utf-8", "replace")))
            stop = cut


def parse(data: bytes, at: int, headers: Headers | None = None) -> tuple[int, dict[str, str], int, int] | None:
    """The candidate record at an offset: its successor, headers, and where its block starts and ends; None if what stands
    there is no record that ends within the file. ``headers``: kept from the candidates in front."""
    found = (headers or Headers(data)).at(at + len(MAGIC))
    if found is None:
        return None
    head, fields = found
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    start = head + 4
    stop = start + int(length)
    if data[stop : stop + 4] != END.encode():
        return None
    return stop + 4, fields, start, stop


CANDIDATES = "path string, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every place in the archives where a record may start, with its successor's offset and what the record says, and a row
    for the end of each archive, which follows itself and says nothing."""

    def number(name: str | None) -> int | None:
        tail = (name or "").rpartition(":")[2].rstrip(">")
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema(
            [("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
        )
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, at, headers = [], data.find(MAGIC), Headers(data)
                while at >= 0:
                    if (found := parse(data, at, headers)) is not None:
                        following, fields, start, stop = found
                        body = data.find(END.encode(), start, stop)
                        http = data[start : body if body >= 0 else start].decode("latin-1").lower()
                        said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        if fields.get("warc-type") == "revisit":
                            size = next((int(x.partition(": ")[2]) for x in http.split("\r\n") if x.startswith("content-length: ")), None)
                            rows.append((path, at, following, number(fields.get("warc-record-id")), size, said, "revisit", number(fields.get("warc-refers-to")), True))
                        else:
                            payload = data[body + 4 if body >= 0 else start : stop]
                            digest = hashlib.sha256(payload).hexdigest()
                            rows.append((path, at, following, number(fields.get("warc-record-id")), len(payload), digest, fields.get("warc-type"), None, digest == said))
                    at = data.find(MAGIC, at + 1)
                rows.append((path, len(data), len(data), None, None, None, None, None, None))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, CANDIDATES)


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping: every round adds what the known ones point to
    and squares the links, so n records take about log2(n) rounds. ``at`` ascends; a link to no candidate ends the chain."""
    n = len(at)
    if not n:
        return np.zeros(0, bool)
    to = np.minimum(np.searchsorted(at, successor), n - 1)
    jump = np.append(np.where(at[to] == successor, to, n), n)  # n: nowhere
    known = np.append(at == 0, False)
    while True:
        grown = known.copy()
        grown[jump[known.nonzero()[0]]] = True
        grown[n] = False
        if (grown == known).all():
            return known[:n]
        known, jump = grown, jump[jump]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The true records of the archives in ``folder``. An archive whose chain does not lead to its end is an error."""

    def verify(table):
        import pyarrow as pa

        table = table.sort_by("at")
        keep = reachable(table["at"].to_numpy(), table["next"].to_numpy())
        if not keep[-1]:
            reached = table["next"].to_numpy()[keep.nonzero()[0]]
            raise ValueError(f"{table['path'][0]}: the chain of records ends at {max(reached, default=0)} of {table['at'][-1]} bytes")
        return table.slice(0, len(keep) - 1).filter(pa.array(keep[:-1]))

    return candidates(spark, folder).groupBy("path").applyInArrow(verify, CANDIDATES)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return what the records say."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest from pages),
s as (select *, strlen(html) as payload_bytes, min(page_id) over (partition by payload_digest) as first from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first then first end as refers_to, true as intact from s
"""
