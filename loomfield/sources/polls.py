"""Saved polls as a stream: one file per board and poll, read once each, with failed lines as degraded rows.

    spark.dataSource.register(PollStream)
    spark.readStream.format("board_polls").option("path", folder).load()

A folder holds ``<board>/<number>.jsonl`` per poll, one response a line. The offset is the last poll of each board, so a batch is
the polls between two offsets, whatever else arrives meanwhile, and a restarted query reads the same ones again. Names that
are no numbers are no polls. ``boards`` limits a batch to so many new polls of a board (default: all).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomfield.sources.archive import _store

SCHEMA = "board_id long, poll long, line int, ats string, slug string, http_status int, body string, degraded boolean, reason string"


class Polls(InputPartition):
    def __init__(self, board: str, polls: list[int]):
        self.board, self.polls = board, polls


def parsed(board: str, poll: int, line: int, said: str) -> tuple:
    """The row of one saved response; what is no response is a degraded row with the reason."""
    try:
        r = json.loads(said)
    except ValueError:
        return int(board), poll, line, None, None, None, said, True, "not json"
    if not isinstance(r, dict) or not isinstance(r.get("body"), (str, type(None))):
        return int(board), poll, line, None, None, None, said, True, "not a response"
    status = r.get("http_status")
    if not isinstance(status, int) or isinstance(status, bool):
        return int(board), poll, line, r.get("ats"), r.get("slug"), None, r.get("body"), True, "no status"
    return int(board), poll, line, r.get("ats"), r.get("slug"), status, r.get("body"), False, None


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("polls", "0"))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _listed(self) -> dict[str, list[int]]:
        from pyarrow import fs

        store, root = _store(self.path)
        out: dict[str, list[int]] = {}
        for i in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = i.path[len(root) :].strip("/").split("/")
            if len(parts) == 2 and parts[0].isdigit() and parts[1].endswith(".jsonl") and parts[1][:-6].isdigit():
                out.setdefault(parts[0], []).append(int(parts[1][:-6]))
        return {b: sorted(p) for b, p in out.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        end = dict(self.known)
        for board, polls in self._listed().items():
            new = [p for p in polls if p > self.known.get(board, -1)]
            if new:
                end[board] = new[min(self.most, len(new)) - 1] if self.most else new[-1]
        self.known = end
        return {b: end[b] for b in sorted(end)}

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        self.known = {b: max(n, self.known.get(b, -1)) for b, n in end.items()} | {b: n for b, n in self.known.items() if b not in end}
        listed = self._listed()
        between = {b: [p for p in listed.get(b, []) if start.get(b, -1) < p <= last] for b, last in end.items()}
        return [Polls(b, polls) for b, polls in sorted(between.items()) if polls]

    def read(self, partition: Polls) -> Iterator[tuple]:
        store, root = _store(self.path)
        for poll in partition.polls:
            name = next(n for n in (f"{poll:08d}", str(poll)) if store.get_file_info(f"{root}/{partition.board}/{n}.jsonl").size is not None)
            with store.open_input_stream(f"{root}/{partition.board}/{name}.jsonl") as f:
                for n, said in enumerate(f.read().decode("utf-8", "replace").split("\n"), 1):
                    if said.strip():
                        yield parsed(partition.board, poll, n, said)

    def commit(self, end: dict) -> None:
        pass


class PollStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board_polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PollReader:  # noqa: N802
        return PollReader(self.options)
