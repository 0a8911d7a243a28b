"""A document that consists of lists, written as one file by many tasks: a Python data source's writer with ordered parts.

Rows (section, text) come in range partitions of their order. A task writes its rows of each section to a file of its own beside
the document, in the same folder; the commit joins the sections' openings, the files in order of their partitions, and the
closings, piece by piece, and gives the document its name last. A task that is run again writes another file, and only files of
committed tasks are joined; an abort takes them away. The folder must be one that driver and executors mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that the commit copies at once.
CHUNK = 1 << 20


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: dict[int, str]


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.lists = [tuple(x) for x in json.loads(options["lists"])]
        self.separator = options.get("separator", ",")
        self.run = uuid.uuid4().hex

    def write(self, rows):
        from pyspark import TaskContext

        folder = os.path.dirname(self.path) or "."
        files, out = {}, {}
        try:
            for section, text in rows:
                if section not in out:
                    files[section] = os.path.join(folder, f".{os.path.basename(self.path)}.{self.run}.{uuid.uuid4().hex}")
                    out[section] = open(files[section], "w", encoding="utf-8", newline="")  # noqa: SIM115
                else:
                    out[section].write(self.separator)
                out[section].write(text)
        finally:
            for f in out.values():
                f.close()
        return _Written(TaskContext.get().partitionId(), files)

    def _parts(self) -> list[str]:
        folder = os.path.dirname(self.path) or "."
        return [os.path.join(folder, n) for n in os.listdir(folder) if n.startswith(f".{os.path.basename(self.path)}.{self.run}.")]

    def commit(self, messages):
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        whole = os.path.join(os.path.dirname(self.path) or ".", f".{os.path.basename(self.path)}.{self.run}.whole")
        with open(whole, "wb") as out:
            for section, (start, end) in enumerate(self.lists):
                out.write(start.encode())
                for k, name in enumerate(m.files[section] for m in done if section in m.files):
                    out.write(self.separator.encode() if k else b"")
                    with open(name, "rb") as part:
                        shutil.copyfileobj(part, out, CHUNK)
                out.write(end.encode())
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages):
        for name in self._parts():
            os.unlink(name)


class Lists(DataSource):
    @classmethod
    def name(cls):
        return "lists"

    def schema(self):
        return "section int, text string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_lists(rows: DataFrame, path: str, lists, partitions: int | None = None, separator: str = ",") -> None:
    """rows: section, k, ord, text. lists: an opening and a closing for each section. A document of this name is replaced."""
    rows.sparkSession.dataSource.register(Lists)
    order = ["section", "k", "ord"]
    d = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    d = d.sortWithinPartitions(*order).select("section", "text")
    d.write.format("lists").mode("append").option("path", path).option("lists", json.dumps([list(x) for x in lists])).option("separator", separator).save()
