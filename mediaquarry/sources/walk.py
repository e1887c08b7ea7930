"""File trees as a data source, and content hashes of whole files of any size.

``FileTree`` walks a tree in parallel: the driver opens folders from the root down until there are enough of them, each task
walks what is below one.  So the driver holds folders, never the list of files, and hidden or excluded folders are not
entered at all.

``hashed`` plans its tasks by bytes: the files' lengths are summed up over all partitions, every ``task_bytes`` of them are
one task (a longer file is a task of its own), and a task reads its files once, chunk by chunk, feeding both digests.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import stat
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.mutations import running

SCHEMA = "path string, length long, modified_at timestamp_ntz"
SPLITS = 256
TASK_BYTES, CHUNK, OPEN_BYTES = 1 << 30, 4 << 20, 1 << 16


class Store:
    """Files by path: local ones, and whatever ``pyarrow.fs`` knows by its scheme."""

    def __init__(self, root: str):
        scheme = re.match(r"([a-z][a-z0-9+.-]+)://?", root)
        self.prefix, self.fs = "", None
        if scheme and scheme[1] != "file":
            from pyarrow import fs

            self.fs, inner = fs.FileSystem.from_uri(root)
            self.prefix = root[: len(root) - len(inner)] if root.endswith(inner) else f"{scheme[1]}://"
        self.root = root.rstrip("/")

    def _plain(self, path: str) -> str:
        return path.removeprefix(self.prefix) if self.fs else re.sub(r"^file:/+", "/", path)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, datetime]]:
        """(path, is a folder, length, modified at) of what is directly in a folder; links and special files are left out."""
        if self.fs:
            from pyarrow import fs

            for x in self.fs.get_file_info(fs.FileSelector(self._plain(folder))):
                yield self.prefix + x.path, x.type == fs.FileType.Directory, x.size or 0, (x.mtime or datetime.fromtimestamp(0, timezone.utc)).replace(tzinfo=None)
            return
        with os.scandir(self._plain(folder)) as found:
            for x in found:
                kind = x.stat(follow_symlinks=False)
                if stat.S_ISDIR(kind.st_mode) or stat.S_ISREG(kind.st_mode):
                    yield f"{folder.rstrip('/')}/{x.name}", stat.S_ISDIR(kind.st_mode), kind.st_size, datetime.fromtimestamp(kind.st_mtime, timezone.utc).replace(tzinfo=None)

    def open(self, path: str):
        return self.fs.open_input_file(self._plain(path)) if self.fs else open(self._plain(path), "rb", buffering=0)

    def delete(self, path: str) -> None:
        if self.fs:
            self.fs.delete_file(self._plain(path))
        else:
            os.unlink(self._plain(path))

    def gather(self, path: str, front: bytes, parts: list[str], back: bytes, chunk: int = CHUNK) -> None:
        """Writes other files in a row into one, chunk by chunk; whole or not at all.  Parts may lie in another store."""
        inner = self._plain(path)
        other = f"{inner}.{os.getpid()}.part"
        if not self.fs:
            os.makedirs(os.path.dirname(inner), exist_ok=True)
        with self.fs.open_output_stream(other) if self.fs else open(other, "wb") as out:
            out.write(front)
            for part in parts:
                with Store(part).open(part) as f:
                    while piece := f.read(chunk):
                        out.write(piece)
            out.write(back)
        self.fs.move(other, inner) if self.fs else os.replace(other, inner)

    def write(self, path: str, content: bytes) -> None:
        """Whole or not at all: under another name first."""
        inner = self._plain(path)
        other = f"{inner}.{os.getpid()}.part"
        if self.fs:
            self.fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with self.fs.open_output_stream(other) as f:
                f.write(content)
            self.fs.move(other, inner)
        else:
            os.makedirs(os.path.dirname(inner), exist_ok=True)
            with open(other, "wb") as f:
                f.write(content)
            os.replace(other, inner)


class _Part(InputPartition):
    def __init__(self, folder: str, whole: bool):
        self.folder, self.whole = folder, whole


class _Walk(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.splits = int(options.get("splits", SPLITS))
        self.hidden = options.get("hidden", "false").lower() == "true"
        pruned = json.loads(options.get("pruned", "[]"))
        self.pruned = re.compile("|".join(fnmatch.translate(p.lower()) for p in pruned)) if pruned else None

    def _entered(self, path: str) -> bool:
        name = path.rsplit("/", 1)[1]
        return (self.hidden or not name.startswith(".")) and not (self.pruned and self.pruned.fullmatch(name.lower()))

    def _inside(self, store: Store, folder: str) -> tuple[list[str], list[tuple]]:
        folders, found = [], []
        try:
            for path, is_folder, length, modified in store.entries(folder):
                if is_folder:
                    if self._entered(path):
                        folders.append(path)
                elif self.hidden or not path.rsplit("/", 1)[1].startswith("."):
                    found.append((path, length, modified))
        except FileNotFoundError:  # gone since it was listed
            if folder == store.root:
                raise
        return folders, found

    def partitions(self) -> list[InputPartition]:
        store = Store(self.root)
        opened, waiting = [], [store.root]
        while waiting and len(opened) + len(waiting) < self.splits:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += sorted(self._inside(store, folder)[0])
        return [*(_Part(f, False) for f in opened), *(_Part(f, True) for f in waiting)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, folders = Store(self.root), [partition.folder]
        while folders:
            inner, found = self._inside(store, folders.pop())
            if partition.whole:
                folders += inner
            for k in range(0, len(found), 8192):
                paths, lengths, times = zip(*found[k : k + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(times, pa.timestamp("us"))], names=["path", "length", "modified_at"])


class FileTree(DataSource):
    """``spark.read.format("filetree")``: regular files below ``path``.  Options: splits, hidden, pruned (a JSON list of
    patterns of folder names, in any case, that are not entered)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Walk(dict(self.options))


def tree(spark: SparkSession, root: str, pruned: Iterable[str] = (), hidden: bool = False, splits: int = SPLITS) -> DataFrame:
    """(path, length, modified_at in UTC) of the regular files below a root; links are not followed, an absent root is an error."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("pruned", json.dumps(list(pruned))).option("hidden", hidden).option("splits", splits).load(root)


def digests(store: Store, path: str, chunk: int = CHUNK) -> tuple[int, str, str]:
    """(bytes read, SHA-256, MD5) of a file read once, a chunk at a time."""
    sha, md, length = hashlib.sha256(), hashlib.md5(usedforsecurity=False), 0
    with store.open(path) as f:
        while piece := f.read(chunk):
            sha.update(piece)
            md.update(piece)
            length += len(piece)
    return length, sha.hexdigest(), md.hexdigest()


def hashed(files: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` (path, length, more) with ``read_bytes``, ``sha256`` and ``md5``, all null for a file that can't be read.

    ``root`` tells the store.  Repeated rows are read each; without rows nothing is.
    """
    kept = [c for c in files.columns if c not in ("read_bytes", "sha256", "md5")]
    size = F.least(F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)), F.lit(task_bytes))  # a longer file fills one task, no more
    weighed = files.select(*kept, (size + OPEN_BYTES).cast("long").alias("__bytes"))
    placed, total = running(weighed, "__bytes", "__from", "to_hash")
    tasks = max(1, -(-total // task_bytes))
    dealt = placed.repartitionById(tasks, F.floor(F.col("__from") / task_bytes).cast("int")).select(*kept)

    def run(batches):
        store = Store(root)

        def one(path):
            try:
                return digests(store, path)
            except OSError:
                return None, None, None

        for batch in batches:
            found = [one(p) if p is not None else (None,) * 3 for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())],
                names=[*batch.schema.names, "read_bytes", "sha256", "md5"],
            )

    new = [StructField("read_bytes", LongType()), StructField("sha256", StringType()), StructField("md5", StringType())]
    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, *new]))


def stored(rows: DataFrame, path: str, content: str, root: str) -> DataFrame:
    """Writes a file for each row below the root (``path`` is relative, null content an empty file); gives back each path and its bytes.

    A file is there whole or not at all, so a repeated task does no harm.
    """

    def run(batches):
        store = Store(root)
        for batch in batches:
            sizes = []
            for name, value in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = value.as_py() or b""
                store.write(f"{store.root}/{name}", raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "length"])

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, length long")
