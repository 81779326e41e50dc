"""The change journal as a data source of its own, in batch and as a stream: `spark.read.format("quarry_journal")`.

Offsets are (journal id, usn): a stream that is started again from its checkpoint goes on behind the last record it has
committed, and stops with an error if the journal is another one by then, which asks for a rebuild. A batch of a stream is a
range of usn, cut into as many parts as asked for, each read by a task of its own with the range pushed into the files. How
far the journal goes is told by the files' statistics; no record is read for it.

Options: path (a Parquet file or folder that pyarrow can open where the tasks run), journal_id, partitions (8), per_batch
(records of a stream's batch at most, by usn; unlimited), until (a usn behind which the journal isn't looked at).
Records without a usn can't be placed and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "usn long, id long, event_type string"


@dataclass
class Stretch(InputPartition):
    first: int
    behind: int


def _files(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file://"), format="parquet")


def bounds(path: str) -> tuple[int, int]:
    """The first usn and that behind the last, from the statistics of row groups."""
    low, high = [], []
    for fragment in _files(path).get_fragments():
        meta = fragment.metadata
        at = meta.schema.names.index("event_id")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            if s is not None and s.has_min_max:
                low.append(s.min)
                high.append(s.max)
    return (min(low), max(high) + 1) if low else (0, 0)


def stretches(first: int, behind: int, parts: int) -> list[Stretch]:
    step = max(1, -(-(behind - first) // parts))
    return [Stretch(a, min(a + step, behind)) for a in range(first, behind, step)]


def records(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    usn = pc.field("event_id")
    found = _files(path).to_batches(columns={"usn": usn, "id": pc.field("user_id"), "event_type": pc.field("event_type")}, filter=(usn >= part.first) & (usn < part.behind))
    kinds = pa.schema([("usn", pa.int64()), ("id", pa.int64()), ("event_type", pa.string())])
    for batch in found:
        if len(batch):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds)], schema=kinds)


class _Options:
    def __init__(self, options: dict):
        self.path, self.journal_id = options["path"], int(options.get("journal_id", 0))
        self.parts, self.per_batch = int(options.get("partitions", 8)), int(options.get("per_batch", 0))
        self.until = int(options["until"]) if "until" in options else None

    def bounds(self) -> tuple[int, int]:
        first, behind = bounds(self.path)
        return first, behind if self.until is None else max(first, min(behind, self.until))


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Stretch]:
        return stretches(*self.options.bounds(), self.options.parts) or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return records(self.options.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options, self.at = options, None

    def _offset(self, usn: int) -> dict:
        return {"journal_id": self.options.journal_id, "usn": usn}

    def initialOffset(self) -> dict:
        return self._offset(self.options.bounds()[0])

    def latestOffset(self) -> dict:
        first, behind = self.options.bounds()
        if self.options.per_batch:
            self.at = min(behind, (first if self.at is None else self.at) + self.options.per_batch)
            return self._offset(self.at)
        return self._offset(behind)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        if start["journal_id"] != self.options.journal_id:
            raise LookupError(f"the offset is of journal {start['journal_id']}, not of {self.options.journal_id}: scan the source anew")
        self.at = max(self.at or 0, end["usn"])
        return stretches(start["usn"], end["usn"], self.options.parts)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return records(self.options.path, partition)

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)
