"""The raw archive as a data source: rows go to gzipped JSON lines by day and shard, and each has a reference that reads it back.

    spark.dataSource.register(RawArchive)
    rows.write.format("raw_archive").option("path", folder).mode("append").save()   # columns key, day, shard and any others
    refs(spark, folder)                  # (key, ref) of all committed rows
    lines(spark, folder, some_refs)      # (ref, row): the rows that references stand for, as JSON

Every task writes files of its own and counts its lines itself, so a reference ("run/raw-day/shard-task.jsonl.gz#line") is right by
construction. A write is all or nothing: files count only once a manifest lists them, which the commit puts in place by one
rename; a failed write's folder is removed, and what a killed driver leaves is in no manifest. Paths may be of any file system
that Arrow knows. Rows should come sorted by day and shard within partitions (``by_file``); a task holds one open file.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFESTS = "_manifests"


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.FileSystem.from_uri(f"file://{path}"))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    index: str | None
    rows: int


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.run = path.rstrip("/"), columns, f"run-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        files, index, here, out, line, count = [], [], None, None, 0, 0
        for row in rows:
            r = {c: row[i] for i, c in enumerate(self.columns)}
            place = (str(r["day"]), str(r["shard"]))
            if place != here:
                if out is not None:
                    out.close()
                here, line = place, 0
                files.append(f"{self.run}/raw-{place[0]}/shard-{place[1]}-{task}-{len(files)}.jsonl.gz")
                store.create_dir(f"{root}/{self.run}/raw-{place[0]}", recursive=True)
                out = gzip.GzipFile(fileobj=store.open_output_stream(f"{root}/{files[-1]}"), mode="wb")
            line, count = line + 1, count + 1
            out.write(json.dumps(r, default=str, ensure_ascii=False).encode() + b"\n")
            index.append(json.dumps({"key": None if r["key"] is None else str(r["key"]), "ref": f"{files[-1]}#{line}"}))
        if out is not None:
            out.close()
            out.fileobj.close() if out.fileobj else None
        if not index:
            return Written([], None, 0)
        name = f"{self.run}/index-{task}.jsonl"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write("\n".join(index).encode())
        return Written(files, name, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        done = [m for m in messages if m is not None and m.rows]
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        with store.open_output_stream(f"{root}/{MANIFESTS}/.{self.run}") as f:
            f.write(json.dumps({"index": [m.index for m in done], "files": [x for m in done for x in m.files], "rows": sum(m.rows for m in done)}).encode())
        store.move(f"{root}/{MANIFESTS}/.{self.run}", f"{root}/{MANIFESTS}/{self.run}.json")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class RawArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        missing = {"key", "day", "shard"} - set(schema.names)
        if missing:
            raise ValueError(f"the archive needs columns {sorted(missing)}")
        if overwrite:
            raise ValueError("the archive is only ever appended to")
        return ArchiveWriter(self.options["path"], schema.names)


def by_file(rows: DataFrame) -> DataFrame:
    """``rows`` dealt so that a task writes whole days and shards one after the other; a hot one may be split over tasks by Spark."""
    return rows.repartition("day", "shard").sortWithinPartitions("day", "shard")


def _manifests(path: str) -> list[dict]:
    from pyarrow import fs

    store, root = _store(path.rstrip("/"))
    if store.get_file_info(f"{root}/{MANIFESTS}").type != fs.FileType.Directory:
        return []
    found = [i.path for i in store.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}")) if i.base_name.endswith(".json") and not i.base_name.startswith(".")]
    out = []
    for p in sorted(found):
        with store.open_input_stream(p) as f:
            out.append(json.loads(f.read()))
    return out


def refs(spark: SparkSession, path: str) -> DataFrame:
    """(key, ref) of every committed row."""
    listed = [f"{path.rstrip('/')}/{x}" for m in _manifests(path) for x in m["index"]]
    schema = "key string, ref string"
    return spark.read.schema(schema).json([x if "://" in x else f"file://{x}" for x in listed]) if listed else spark.createDataFrame([], schema)


def lines(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(ref, row) of the references in ``wanted``: each file is read once, by one task. A reference that names no row gives a null."""
    folder = path.rstrip("/")

    def run(batches):
        import pandas as pd

        store, root = _store(folder)
        for batch in batches:
            out = []
            for file, part in batch.groupby("file"):
                need = dict(zip(part["line"], part["ref"], strict=True))
                try:
                    with store.open_input_stream(f"{root}/{file}") as raw, gzip.open(io.BufferedReader(raw)) as f:
                        for n, said in enumerate(f, 1):
                            if n in need:
                                out.append((need.pop(n), said.decode().rstrip("\n")))
                            if not need:
                                break
                except OSError:
                    pass
                out += [(ref, None) for ref in need.values()]
            yield pd.DataFrame(out, columns=["ref", "row"])

    split = wanted.select("ref", F.substring_index("ref", "#", 1).alias("file"), F.substring_index("ref", "#", -1).try_cast("long").alias("line")).distinct()
    return split.repartition("file").sortWithinPartitions("file", "line").mapInPandas(run, "ref string, row string")
