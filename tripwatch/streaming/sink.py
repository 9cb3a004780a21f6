"""A streaming sink that posts rows, such as the binding sets of reports, to an HTTP endpoint.

    spark.dataSource.register(BindingSetSink)
    rows.writeStream.format("binding_sets").option("endpoint", url).option("staging", folder).option("checkpointLocation", c).start()

Tasks write their rows to the staging folder, one query's own, which all machines share. Only when all tasks of a batch are done does the driver post
the files, piece by piece, so a failed task posts nothing. A batch that was posted whole leaves a mark, and isn't posted
again after a restart; if the driver was lost in the middle of it, its pieces are posted again under the same batch and piece
numbers, which a receiver can drop.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..sources.files import Folder


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


class BindingSetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binding_sets"

    def streamWriter(self, schema, overwrite):
        return BindingSetWriter(self.options)


class BindingSetWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.endpoint, self.staging = options["endpoint"], options["staging"]
        self.piece, self.headers = int(options.get("piece", 100)), json.loads(options.get("headers", "{}"))

    def write(self, iterator) -> Staged:
        name = f"rows-{uuid.uuid4().hex}"
        lines = (json.dumps({k: v for k, v in row.asDict(True).items() if v is not None}, default=str).encode() + b"\n" for row in iterator)
        return Staged(name, Folder(self.staging).write(name, lines))

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        folder, mark = Folder(self.staging), f"posted-{batchId:020d}"
        if not folder.has(mark):
            for number, piece in enumerate(self._pieces(folder, messages)):
                body = json.dumps({"batch": batchId, "piece": number, "bindingSet": piece}).encode()
                request = urllib.request.Request(self.endpoint, body, {"Content-Type": "application/json"} | self.headers, method="POST")
                urllib.request.urlopen(request, timeout=60).close()
            folder.write(mark, iter([b"\n"]))
        folder.clear("rows-")  # also those of tasks that failed; the folder is one query's, which has one batch at a time

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        folder = Folder(self.staging)
        for m in messages:
            if m:
                folder.remove(m.name)

    def _pieces(self, folder: Folder, messages: list[Staged | None]) -> Iterator[list[dict]]:
        """The rows of the files in the order of their tasks, some at a time."""
        kept: list[dict] = []
        for m in messages:
            for line in folder.lines(m.name) if m and m.rows else ():
                kept.append(json.loads(line))
                if len(kept) == self.piece:
                    yield kept
                    kept = []
        if kept:
            yield kept
