"""A change journal as a streaming source: segments in a folder, offsets, a backlog since the last commit, reasons for recovery.

A journal is a folder of Parquet segments ``{first}-{last}.parquet`` (sequence numbers, first and last of the segment) beside
``JOURNAL.json``, which holds the journal's id.  Whoever records changes adds segments (``append``) and drops old ones
(``truncate``).  Offsets are sequence numbers: the names of the segments tell them all, so no data is read to plan a batch, and
each segment of a batch is a task.

A batch that can't be complete says why in a row of its own, with nothing but ``recovery``: EVENTS_LOST (the journal no
longer reaches back to the offset), UNREPLAYABLE (another journal than the offset's), INCOMPLETE (a segment is missing in
between).  ``changes.needs_full_pass`` asks for a full reconciliation then.

The cursor is the offset that a complete walk has covered.  ``walked`` captures the journal's end before the walk and commits it
only after a complete one; a stream without a checkpoint of its own begins at the cursor: what it gets first is the backlog.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.mutations import running
from ..sources.walk import Store

SCHEMA = "seq long, file_ref long, path string, reason_flags int, directory boolean, happened_at timestamp, recovery string"
_COLUMNS = ["seq", "file_ref", "path", "reason_flags", "directory", "happened_at"]
_ARROW = pa.schema([("seq", pa.int64()), ("file_ref", pa.int64()), ("path", pa.string()), ("reason_flags", pa.int32()), ("directory", pa.bool_()), ("happened_at", pa.timestamp("us", tz="UTC")), ("recovery", pa.string())])
_SEGMENT = re.compile(r"(\d+)-(\d+)\.parquet$")


class Journal:
    """The segments of a folder."""

    def __init__(self, folder: str):
        self.store = Store(folder)
        self.folder = self.store.root

    def identity(self) -> str:
        with self.store.open(f"{self.folder}/JOURNAL.json") as f:
            return json.loads(f.read())["id"]

    def segments(self) -> list[tuple[int, int, str]]:
        """(first, last, path), ascending."""
        found = ((_SEGMENT.search(path), path) for path, is_folder, _, _ in self.store.entries(self.folder) if not is_folder)
        return sorted((int(m[1]), int(m[2]), path) for m, path in found if m)

    def end(self) -> dict:
        """The offset behind the last segment.  (A folder holds segments' names only: a listing.)"""
        return {"journal": self.identity(), "next": max((last + 1 for _, last, _ in self.segments()), default=0)}

    def start(self) -> dict:
        return {"journal": self.identity(), "next": min((first for first, _, _ in self.segments()), default=0)}

    def plan(self, start: dict, end: dict) -> tuple[list[tuple[str, int, int]], str | None]:
        """The (path, from, up to) to read between two offsets, and why they are not all there is, if so."""
        if start["journal"] != end["journal"]:
            reason, low = "UNREPLAYABLE", 0
        else:
            reason, low = None, start["next"]
        parts, at = [], low
        for first, last, path in self.segments():
            if last < low or first >= end["next"]:
                continue
            if first > at and not reason:
                reason = "INCOMPLETE" if parts else "EVENTS_LOST"
            parts.append((path, max(first, low), min(last + 1, end["next"])))
            at = max(at, last + 1)
        if at < end["next"] and not reason:
            reason = "INCOMPLETE" if parts else "EVENTS_LOST"
        return parts, reason


class _Part(InputPartition):
    def __init__(self, path: str | None, low: int = 0, high: int = 0, reason: str | None = None):
        self.path, self.low, self.high, self.reason = path, low, high, reason


def _parts(journal: Journal, start: dict, end: dict) -> list[InputPartition]:
    found, reason = journal.plan(start, end)
    return [*(_Part(*p) for p in found), *([_Part(None, reason=reason)] if reason else [])] or [_Part(None)]


def _read(folder: str, part: _Part) -> Iterator[pa.RecordBatch]:
    if part.path is None:
        if part.reason:
            yield pa.RecordBatch.from_pylist([{"recovery": part.reason}], schema=_ARROW)
        return
    with Store(folder).open(part.path) as f:
        for batch in pq.ParquetFile(f).iter_batches(columns=_COLUMNS):
            seq = batch.column("seq")
            rows = pa.Table.from_batches([batch]).filter(pc.and_(pc.greater_equal(seq, part.low), pc.less(seq, part.high)))
            whole = rows.append_column("recovery", pa.nulls(len(rows), pa.string()))
            yield from whole.select(_ARROW.names).cast(_ARROW).to_batches()


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.journal, self.cursor = Journal(options["path"]), options.get("cursor")

    def initialOffset(self) -> dict:
        return (read_cursor(self.cursor) if self.cursor else None) or self.journal.start()

    def latestOffset(self) -> dict:
        return self.journal.end()

    def partitions(self, start: dict, end: dict):
        return _parts(self.journal, start, end) if start != end else [_Part(None)]

    def read(self, partition):
        return _read(self.journal.folder, partition)

    def commit(self, end: dict) -> None:
        """Offsets are kept by the stream's checkpoint; the cursor moves with complete walks only."""


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.journal, self.cursor = Journal(options["path"]), options.get("cursor")

    def partitions(self):
        start = (read_cursor(self.cursor) if self.cursor else None) or self.journal.start()
        return _parts(self.journal, start, self.journal.end())

    def read(self, partition):
        return _read(self.journal.folder, partition)


class JournalSource(DataSource):
    """``format("journal")`` with ``path`` and, to begin where the last complete walk did, ``cursor``."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _reader(reader, spark: SparkSession, folder: str, cursor: str | None):
    spark.dataSource.register(JournalSource)
    return (reader.format("journal").option("cursor", cursor) if cursor else reader.format("journal")).load(folder)


def stream(spark: SparkSession, folder: str, cursor: str | None = None) -> DataFrame:
    """The journal's changes from the cursor (or its start) on; a restarted query goes on where its checkpoint ends."""
    return _reader(spark.readStream, spark, folder, cursor)


def offline_backlog(spark: SparkSession, folder: str, cursor: str | None = None) -> DataFrame:
    """What was recorded since the cursor, as a table: the changes of the time when nothing ran."""
    return _reader(spark.read, spark, folder, cursor)


def read_cursor(path: str) -> dict | None:
    store = Store(path.rsplit("/", 1)[0])
    try:
        with store.open(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def commit_cursor(path: str, offset: dict) -> dict:
    """Moves the cursor; within one journal never back.  The file is replaced as a whole."""
    known = read_cursor(path)
    if known and known["journal"] == offset["journal"] and known["next"] >= offset["next"]:
        return known
    Store(path.rsplit("/", 1)[0]).write(path, json.dumps(offset).encode())
    return offset


def walked(folder: str, cursor: str, walk: Callable[[], bool]) -> bool:
    """Runs a walk; the cursor then stands where the journal ended before it, if the walk was complete.

    What changes while the walk runs is after the cursor, so it is seen again by whoever reads on.
    """
    captured = Journal(folder).end()
    complete = walk()
    if complete:
        commit_cursor(cursor, captured)
    return complete


def create(folder: str, identity: str) -> None:
    """A new journal; over an old one it is another journal, whose offsets mean nothing for it."""
    Store(folder).write(f"{folder.rstrip('/')}/JOURNAL.json", json.dumps({"id": identity}).encode())


def append(changes: DataFrame, folder: str, segment_rows: int = 1 << 20) -> int:
    """Adds rows (file_ref, path, reason_flags, directory, happened_at, in the order of ``seq``) behind the journal's end.

    Sequence numbers are given anew, without gaps; a segment's task writes its file whole, under its final name.  Returns
    the number of rows.  One writer at a time.
    """
    base = Journal(folder).end()["next"]
    sized = changes.select("seq", *_COLUMNS[1:], F.lit(1).alias("__one")).repartitionByRange("seq").sortWithinPartitions("seq")
    placed, total = running(sized, "__one", "__at", "journal")
    if not total:
        return 0
    dealt = placed.repartitionById(-(-total // segment_rows), F.floor(F.col("__at") / segment_rows).cast("int")).sortWithinPartitions("__at")
    rows = dealt.select((F.col("__at") + base).alias("seq"), "file_ref", "path", F.col("reason_flags").cast("int"), "directory", F.col("happened_at").cast("timestamp"))

    def run(batches):
        parts = list(batches)  # a segment: segment_rows at most
        if parts:
            table = pa.Table.from_batches(parts)
            sink = pa.BufferOutputStream()
            pq.write_table(table, sink)
            first, last = table.column("seq")[0].as_py(), table.column("seq")[-1].as_py()
            Store(folder).write(f"{folder.rstrip('/')}/{first:020d}-{last:020d}.parquet", sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"]


def truncate(folder: str, before: int) -> None:
    """Drops the segments that end before a sequence number."""
    journal = Journal(folder)
    for _, last, path in journal.segments():
        if last < before:
            journal.store.delete(path)
