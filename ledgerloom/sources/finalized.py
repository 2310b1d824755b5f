"""A sink that finalises once: after all tasks of a write have succeeded, and not at all if one fails.

Spark runs tasks again and may run one twice; what must happen once for a whole set of items does
not belong in a task. Tasks of this sink count their items' outcomes, and the counts go to one call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Counted(WriterCommitMessage):
    """What a task saw: the items of each outcome."""

    outcomes: dict[str, int]


def written(path: str, name: str, value: dict) -> None:
    """One small JSON file in a folder of any file system that Arrow knows."""
    uri = "file://" + path.removeprefix("file:").replace("///", "/") if path.startswith(("file:", "/")) else path
    where, folder = fs.FileSystem.from_uri(uri)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/{name}") as out:
        out.write(json.dumps(value).encode())


class Finalizer(DataSource):
    """Format ``finalized``: rows with ``outcome``; a subclass says what is done in the end, by default a file with the counts.

    Options: ``path``, a folder that all share.
    """

    @classmethod
    def name(cls) -> str:
        return "finalized"

    @classmethod
    def finalize(cls, counts: dict[str, int], options: dict[str, str]) -> None:
        written(options["path"], "finalized.json", {"completed": counts.get("Completed", 0), "failed": counts.get("Failed", 0), "finalized": 1})

    @classmethod
    def give_up(cls, options: dict[str, str]) -> None:
        """What is done when a task failed for good; by default nothing."""

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(type(self), dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, kind: type[Finalizer], options: dict[str, str]):
        self.kind, self.options = kind, options

    def write(self, iterator: Iterator[Row]) -> Counted:
        counts: dict[str, int] = {}
        for row in iterator:
            counts[row["outcome"]] = counts.get(row["outcome"], 0) + 1
        return Counted(counts)

    def commit(self, messages: list[Counted | None]) -> None:
        total: dict[str, int] = {}
        for m in messages:
            for outcome, n in (m.outcomes if m else {}).items():
                total[outcome] = total.get(outcome, 0) + n
        self.kind.finalize(total, self.options)

    def abort(self, messages: list[Counted | None]) -> None:
        self.kind.give_up(self.options)


def finalize(processed: DataFrame, path: str, kind: type[Finalizer] = Finalizer) -> None:
    """Run the items of ``processed`` (a frame with ``outcome``) and finalise them once."""
    processed.sparkSession.dataSource.register(kind)
    processed.select("outcome").write.format(kind.name()).mode("append").option("path", path).save()
