"""Hashes and samples in packed blocks: every two blocks meet in a task, and only what is linked leaves.

A block is one row of a written table: some thousand hashes and samples as binary columns.  Blocks meet by a cartesian product
of that table, which copies no row through a shuffle; the compared pairs are never a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import SIDE, Windows, percents
from ..sources.tables import written

WORDS = 4
#: Rows of a block (2 MB of samples), and the rows of it that meet the other block at once.
BLOCK_ROWS, STRIP = 2048, 128


def block_rows_of(rows: int, block_rows: int | None = None) -> int:
    """Rows of a block: small tables take smaller ones, so that tasks have something to share."""
    return block_rows or min(BLOCK_ROWS, max(128, rows // 16))


def packed(rows: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """A written table with a row for each ``block`` (int, about so many): the other columns' values in order, as binary; with the block's
    number of rows.  It has some dozens of files and more, so that however small it is, tasks share it."""
    columns = [c for c in rows.columns if c != "block"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        out = {"block": table.column("block")[:1], "n": pa.array([len(table)], pa.int32())}
        for c in columns:
            out[c] = pa.array([_bytes(table.column(c))], pa.binary())
        return pa.table(out)

    schema = ", ".join(["block int", "n int", *[f"{c} binary" for c in columns]])
    dealt = rows.repartition(max(1, min(blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism)), "block")
    return written(dealt.groupBy("block").applyInArrow(run, schema), "packed", maxRecordsPerFile=files_of(blocks))


def files_of(blocks: int) -> int:
    """Blocks in a file: 16 (some 30 MB of samples) at most."""
    return min(16, max(1, blocks // 64))


def _bytes(column: pa.ChunkedArray) -> bytes:
    if pa.types.is_binary(column.type):
        values = column.to_pylist()
        wrong = [len(v) for v in values if len(v) != SIDE * SIDE]
        if wrong:
            raise ValueError(f"a sample has {wrong[0]} bytes, not {SIDE * SIDE}")
        return b"".join(values)
    if pa.types.is_floating(column.type):
        return column.to_numpy().astype(np.float64).tobytes()
    return column.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


class Block:
    """A packed row: its columns as arrays; the samples' windows are made when they are asked for."""

    def __init__(self, row: dict[str, object], doubles: tuple[str, ...] = ()):
        self.n, self.row, self.doubles = row["n"], row, doubles
        self.words = [np.frombuffer(row[f"w{i}"], np.uint64) for i in range(WORDS)]
        self._windows: Windows | None = None

    def __getitem__(self, column: str) -> np.ndarray:
        return np.frombuffer(self.row[column], np.float64 if column in self.doubles else np.int64)

    @property
    def windows(self) -> Windows:
        if self._windows is None:
            self._windows = Windows(np.frombuffer(self.row["sample"], np.uint8).reshape(-1, SIDE * SIDE))
        return self._windows


def distances(left: Block, right: Block, rows, others=slice(None), at_once: int = 8) -> np.ndarray:
    """Differing bits of ``rows`` (indices or a slice) of the left block with ``others`` of the right one.

    Word by word over contiguous arrays, some rows at once, so that what is in work fits a core's cache.
    """
    here, there = [w[rows] for w in left.words], [w[others] for w in right.words]
    out = np.zeros((len(here[0]), len(there[0])), np.uint16)
    differ, bits = np.empty((at_once, len(there[0])), np.uint64), np.empty((at_once, len(there[0])), np.uint8)
    for k in range(0, len(out), at_once):
        total = out[k : k + at_once]
        for a, b in zip(here, there):
            x, n = differ[: len(total)], bits[: len(total)]
            np.bitwise_xor(a[k : k + at_once, None], b, out=x)
            np.bitwise_count(x, out=n)
            total += n
    return out


def places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true: ``np.nonzero``, which is slower where that is little."""
    return np.divmod(np.flatnonzero(found), found.shape[1])


def met(left: DataFrame, right: DataFrame, condition: Column | None, task, schema: str, doubles: tuple[str, ...] = ()) -> DataFrame:
    """``task`` (left block, right block) -> arrow tables, for every two blocks; a condition is on l_ and r_ columns."""
    sides = [side.withColumnsRenamed({c: f"{s}_{c}" for c in side.columns}) for side, s in ((left, "l"), (right, "r"))]
    pairs = sides[0].join(sides[1].hint("shuffle_replicate_nl"), F.lit(True) if condition is None else condition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block | None] = [None, None]
        for batch in batches:
            for k in range(len(batch)):
                for s, prefix in enumerate("lr"):
                    row = {c[2:]: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names) if c.startswith(f"{prefix}_")}
                    block = held[s]
                    # the left block often stays: its windows are made once
                    if block is None or block.row["block"] != row["block"] or block.row["file_id"] != row["file_id"]:
                        held[s] = Block(row, doubles)
                for table in task(*held):
                    yield from table.combine_chunks().to_batches()

    return pairs.mapInArrow(run, schema)


def half(blocks: int) -> Column:
    """Each two of so many blocks once, and each with itself; as many for each left block, however blocks are dealt to tasks."""
    ahead = F.pmod(F.col("r_block") - F.col("l_block"), F.lit(blocks))
    return (ahead * 2 < blocks) | ((ahead * 2 == blocks) & (F.col("l_block") < F.col("r_block")))


def linked(left: Block, right: Block, radius: int, minimum: int | None, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, value) by strips: rows inside the radius with their distance; with a minimum those that are similar enough with
    their similarity.  ``within``: the blocks are one, each pair once."""
    own, other = left["file_id"], right["file_id"]
    for k in range(0, left.n, STRIP):
        rows = slice(k, min(k + STRIP, left.n))
        far = distances(left, right, rows)
        i, j = places(far <= radius)
        told = own[i + k] < other[j] if within else own[i + k] != other[j]
        i, j = i[told], j[told]
        if minimum is None:
            yield i + k, j, far[i, j].astype(np.int32)
        elif len(i):
            score = percents(left.windows, right.windows, rows, slice(None), i, j)
            kept = score >= minimum
            yield i[kept] + k, j[kept], score[kept]


def pair_task(radius: int, minimum: int | None, one: bool):
    """(a, b, value) of the linked pairs of two blocks; ``one``: both are of the same table."""

    def task(left: Block, right: Block) -> Iterator[pa.Table]:
        own, other = left["file_id"], right["file_id"]
        for i, j, value in linked(left, right, radius, minimum, one and left.row["block"] == right.row["block"]):
            a, b = own[i], other[j]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "value": value})

    return task


def fit_task(radius: int, minimum: int | None):
    """(file, cluster, n, size): files of the left block that are linked to all n rows that the right block has of a cluster of ``size`` files.

    Similarity is only looked at where the distances of all these rows agree.
    """

    def task(left: Block, right: Block) -> Iterator[pa.Table]:
        own, cluster = left["file_id"], right["cluster"]
        first = np.concatenate(([True], cluster[1:] != cluster[:-1]))
        starts, part = np.flatnonzero(first), np.cumsum(first) - 1
        counts = np.diff(np.append(starts, right.n))
        sizes = right["size"][starts]
        for k in range(0, left.n, STRIP):
            rows = slice(k, min(k + STRIP, left.n))
            i, j = places(distances(left, right, rows) <= radius)
            near = np.bincount(i * len(starts) + part[j], minlength=(rows.stop - k) * len(starts)).reshape(-1, len(starts))
            i, c = places(near == counts)
            if minimum is not None and len(i):
                times = counts[c]
                at = np.repeat(np.cumsum(times) - times, times)
                j = np.arange(len(at)) - at + np.repeat(starts[c], times)
                score = percents(left.windows, right.windows, rows, slice(None), np.repeat(i, times), j)
                kept = np.minimum.reduceat(score, np.cumsum(times) - times) >= minimum
                i, c = i[kept], c[kept]
            yield pa.table({"file": own[i + k], "cluster": cluster[starts[c]], "n": counts[c], "size": sizes[c]})

    return task


def video_task(tolerance: float, aspect: float, radius: int, quorum: int, drop: int, minimum: int):
    """(a, b, score) of the videos of two blocks that are about as long and of about the same shape, by their aligned frames."""

    def task(left: Block, right: Block) -> Iterator[pa.Table]:
        within = left.row["block"] == right.row["block"]
        (own, first, fl), (other, start, fr) = (np.unique(b["file_id"], return_index=True, return_inverse=True) for b in (left, right))
        unknown = left.row["least"] is None
        dl, dr, rl, rr = left["duration"][first], right["duration"][start], left["ratio"][first], right["ratio"][start]
        enough = left["frames"][first], right["frames"][start]
        # some files of the left block at once
        for k in range(0, len(own), STRIP):
            some = slice(k, min(k + STRIP, len(own)))
            gap = np.abs(rl[some, None] - rr) / np.maximum(rl[some, None], rr)
            pair = np.isnan(gap) | (gap <= aspect)  # unknown shapes pass
            if not unknown:
                pair &= np.abs(dl[some, None] - dr) <= tolerance
            pair &= own[some, None] < other if within else own[some, None] != other
            keys, scores = _frame_scores(left, right, fl, fr, k, pair, radius)
            found, times, score = _trimmed(keys, scores, drop)
            i, j = found // len(other) + k, found % len(other)
            kept = (times >= np.minimum(quorum, np.minimum(enough[0][i], enough[1][j]))) & (score >= minimum)
            a, b = own[i[kept]], other[j[kept]]
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score[kept].astype(np.int32)})

    return task


def _frame_scores(left: Block, right: Block, fl: np.ndarray, fr: np.ndarray, first: int, pair: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (place of the left file from ``first`` on, times the right files, plus the right one's) of pairs of files, one for each two
    frames of the same index, and the frames' scores: zero beyond the radius."""
    keys, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    here = np.flatnonzero((fl >= first) & (fl < first + len(pair)))
    for index in np.intersect1d(left["sample_index"][here], right["sample_index"]):
        rows, others = here[left["sample_index"][here] == index], np.flatnonzero(right["sample_index"] == index)
        i, j = np.nonzero(pair[fl[rows] - first][:, fr[others]])
        near = distances(left, right, rows, others)[i, j] <= radius
        score = np.zeros(len(i), np.int32)
        score[near] = percents(left.windows, right.windows, rows, others, i[near], j[near])
        keys.append((fl[rows][i] - first) * pair.shape[1] + fr[others][j])
        scores.append(score)
    return np.concatenate(keys), np.concatenate(scores)


def _trimmed(keys: np.ndarray, scores: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, each once, how often each is there, and the rounded mean of each key's scores without its lowest ``drop``; at least one stays."""
    order = np.lexsort((scores, keys))
    keys, scores = keys[order], scores[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    times = np.diff(np.append(starts, len(keys)))
    skipped = np.minimum(drop, times - 1)
    sums = np.concatenate(([0], np.cumsum(scores, dtype=np.int64)))
    left = sums[starts + times] - sums[starts + skipped]
    return keys[starts], times, np.floor(left / np.maximum(times - skipped, 1) + 0.5)
