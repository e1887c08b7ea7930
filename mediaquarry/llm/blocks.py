"""Blocks of documents, and a word table that meets each block once.

Word-level facts (a count, the ids of a word) are joined at the level of distinct words of a block of documents, not at
every position: the documents are dealt to blocks of about ``block_bytes`` of text by a hash of each row's file and number
there, each map batch sends a block its rows as one compressed Arrow buffer, and a block asks for each of its words once.
Equal rows spread over all blocks, as a row's place and not its content decides; lost tasks and later jobs deal the same.
The size of a block is a parameter and nothing else: it depends on neither the number of partitions nor of cores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_place, text_bytes

_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 2 << 20


def deal(rows: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, piece): the rows of each block as pieces; ``rows`` are ``stored`` ones.  Later uses in a job share the exchange."""
    count = max(1, -(-text_bytes(rows, text_col) // block_bytes))
    keyed = rows.withColumn("__block", F.pmod(row_place(), F.lit(count)).cast("int"))
    return keyed.mapInArrow(_pack, "block int, piece binary").repartition("block")


def _pack(batches):
    for batch in batches:
        if not len(batch):
            continue
        at = batch.schema.get_field_index("__block")
        blocks = batch.column(at).to_numpy()
        order = np.argsort(blocks, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(blocks[order]) != 0, True)) + 1
        rows = pa.Table.from_batches([batch.remove_column(at)])
        out, start = [], 0
        for end in ends.tolist():
            sink = pa.BufferOutputStream()
            part = rows.take(pa.array(order[start:end])).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=_ZSTD) as stream:
                stream.write_table(part)
            out.append((int(blocks[order[start]]), sink.getvalue()))
            start = end
        # a few pieces at a time, so that no batch is much larger than its input
        for k in range(0, len(out), 64):
            some = out[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([p.to_pybytes() for _, p in some], pa.binary())], names=["block", "piece"])


def unpack(pieces: pa.Table) -> Iterator[pa.Table]:
    for piece in pieces.column("piece"):
        yield pa.ipc.open_stream(piece.as_buffer()).read_all()


def chunks(pieces: pa.Table, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """A block's rows in tables of about ``chunk_bytes``, one after the other: small pieces together, large ones cut."""
    held: list[pa.Table] = []
    size = 0
    for piece in unpack(pieces):
        rows = max(1, int(len(piece) * chunk_bytes // max(1, piece.column(text_col).nbytes)))
        for k in range(0, len(piece), rows):
            part = piece if rows >= len(piece) else piece.take(pa.array(np.arange(k, min(k + rows, len(piece)))))  # a copy: Arrow's string functions go wrong on slices
            held.append(part)
            size += part.column(text_col).nbytes
            if size >= chunk_bytes:
                yield pa.concat_tables(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def freed(work: Callable) -> Callable:
    """A block's function that gives Arrow's unused memory back to the system when the block is done."""

    def run(*args):
        out = work(*args)
        pa.default_memory_pool().release_unused()
        return out

    return run


def words_by_block(dealt: DataFrame, words: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What each block asks for: ``words`` gets the pieces of a block and gives a table with a column block."""
    work = freed(words)
    return dealt.groupBy("block").applyInArrow(lambda rows: work(rows), schema)  # the function's number of parameters counts


def per_block(dealt: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Each block's pieces with the answers for its words."""
    done = freed(work)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda rows, found: done(rows, found), schema)
