"""Exports with exact bytes: CSV, JSON, and a ZIP that holds one JSON document."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import running
from .tables import new_path
from .walk import Store


def csv_field(value: Column) -> Column:
    """Null is empty; quoted if it holds a comma, quote or line end, quotes doubled."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line a row, without the line end."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("value"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A folder of part files with CR LF line ends; each part starts with the header."""
    rows.select(*[F.col(c).cast("string") for c in columns]).na.fill("").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def json_lines(rows: DataFrame, hidden: tuple[str, ...] = ("id",)) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in hidden]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str, hidden: tuple[str, ...] = ("id",)) -> None:
    json_lines(rows, hidden).write.mode("overwrite").text(path)


PIECE_BYTES, CHUNK = 8 << 20, 4 << 20


def _times(matrix: list[int], vector: int) -> int:
    """A 32 x 32 bit matrix (its columns as integers) times a vector, modulo two."""
    total = 0
    for column in matrix:
        if not vector:
            break
        if vector & 1:
            total ^= column
        vector >>= 1
    return total


def crc_of_both(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts in a row, from their own and the second's length: zero bytes are a linear step, squared as often
    as the length has bits."""
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, c) for c in step]
    while length:
        if length & 1:
            first = _times(step, first)
        step = [_times(step, c) for c in step]
        length >>= 1
    return first ^ second


def write_zip(header: str, items: DataFrame, order: list[str], path: str, entry: str = "plan.json", piece_bytes: int = PIECE_BYTES) -> int:
    """Writes a ZIP with one document, {"plan": header, "items": [...]}, items in order; returns the document's bytes.

    Tasks deflate their own rows in pieces that end at byte borders, the driver adds up the pieces' checksums and lengths (a
    small row for each piece), and one task puts the pieces, chunk by chunk, into one file.  No row passes the driver, and memory
    is flat.  Lengths are always 64 bits wide.  Without items the list is empty.
    """
    spark = items.sparkSession
    json_rows = items.orderBy(*order).select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("value"), F.lit(1).alias("__one"))
    placed, _ = running(json_rows, "__one", "__at", "zip")
    folder = new_path(spark, "pieces")

    def deflated(batches):
        store, raw, first, out = Store(folder), [], None, []

        def close():
            data = b"".join(raw)
            pressed = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = pressed.compress(data) + pressed.flush(zlib.Z_FULL_FLUSH)
            store.write(f"{folder}/{first:020d}", body)
            out.append({"at": first, "crc": zlib.crc32(data), "length": len(data), "pressed": len(body)})
            raw.clear()

        size = 0
        for batch in batches:
            for at, value in zip(batch.column("__at").to_pylist(), batch.column("value").to_pylist()):
                if not raw:
                    first, size = at, 0
                raw.append((b"," if at else b"") + value.encode())
                size += len(raw[-1])
                if size >= piece_bytes:
                    close()
        if raw:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("at", pa.int64()), ("crc", pa.int64()), ("length", pa.int64()), ("pressed", pa.int64())]))

    pieces = sorted(tuple(r) for r in placed.select("__at", "value").mapInArrow(deflated, "at long, crc long, length long, pressed long").collect())
    front, back = b'{"plan":' + header.encode() + b',"items":[', b"]}"
    ends = []
    for text, mode in ((front, zlib.Z_FULL_FLUSH), (back, zlib.Z_FINISH)):
        pressed = zlib.compressobj(6, zlib.DEFLATED, -15)
        ends.append(pressed.compress(text) + pressed.flush(mode))
    crc, length = zlib.crc32(front), len(front)
    for _, own, size, _ in [*pieces, (0, zlib.crc32(back), len(back), 0)]:
        crc, length = crc_of_both(crc, own, size), length + size
    stored = sum(map(len, ends)) + sum(p[3] for p in pieces)
    name = entry.encode()
    extra = struct.pack("<HHQQ", 1, 16, length, stored)
    common = struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra))
    local = b"PK\3\4" + common + name + extra
    centre = b"PK\1\2" + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name + extra
    at = len(local) + stored
    tail = centre + b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(centre), at) + b"PK\6\7" + struct.pack("<IQI", 0, at + len(centre), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(centre), 0xFFFFFFFF, 0)
    names = [f"{folder}/{p[0]:020d}" for p in pieces]

    def joined(batches):
        for _ in batches:
            Store(path).gather(path, local + ends[0], names, ends[1] + tail, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int64())], names=["length"])

    return spark.range(1).repartition(1).mapInArrow(joined, "length long").first()["length"]
