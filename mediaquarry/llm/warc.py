"""Dictionary-compressed WARC archives: writer and reader.

A ``.warc.zst`` file starts with a skippable frame that holds a Zstandard dictionary, trained on the archive's own records;
every record follows as a frame of its own, so that one record can be read by its offset.  Files are bounded by
``archive_bytes`` of records.  They go to a folder that executors share, under a name that holds the task's attempt; the
manifest, which Spark commits, tells which files count, so that an executor's loss or a second attempt changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, with_groups, written

SKIPPABLE = 0x184D2A5D  # fixed value of the format: the skippable frame of a dictionary
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, PIECE_BYTES, LEAST_BYTES, LEVEL = 16 << 20, 64 << 10, 2 << 20, 16 << 10, 16 << 10, 3
_MANIFEST = "file string, page_id long, offset long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP header alone; its payload's length and digest are still told."""
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page}/{sha1_base32(payload)}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Page-Id", None if page is None else str(page)),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers}/{sha1_base32(payload)}')}>"),
            ("WARC-Refers-To-Target-URI", _clean(refers_url)),
            ("X-Refers-To-Page-Id", None if refers is None else str(refers)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _clean(url: str | None) -> str | None:
    """Control characters and spaces would break a header line: percent-encoded."""
    return None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from evenly spaced pieces of the records, ``sample_bytes`` of them at most.

    Large records are cut into pieces, so that an archive of few large pages has samples enough; the pieces of a small
    archive are given more than once, as the trainer asks for a least number of bytes.
    """
    pieces = [r[k : k + PIECE_BYTES] for r in records for k in range(0, len(r), PIECE_BYTES)]
    step = max(1, -(-sum(map(len, pieces)) // sample_bytes))
    samples = pieces[::step]
    while sum(map(len, samples)) < LEAST_BYTES or len(samples) < 16:
        samples = samples * 2
    size = min(size, max(1024, sum(map(len, samples)) // 8))
    return zstandard.train_dictionary(size, samples, k=512 if size > 4096 else 64, d=8, level=LEVEL).as_bytes()


def write_archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The file's bytes, and each record's offset and length in it.  Every archive has its dictionary."""
    trained = train_dictionary(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    places = []
    for r in records:
        frame = squeeze.compress(r)
        places.append((out.tell(), len(frame)))
        out.write(frame)
    return out.getvalue(), places


def _dictionary(data: bytes) -> tuple[object, int]:
    """The leading dictionary, if any, and where records start."""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        held = data[8 : 8 + size]
        if held[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
            held = zstandard.ZstdDecompressor().decompress(held)
        return zstandard.ZstdCompressionDict(held), 8 + size
    return None, 0


def read_record(data: bytes, offset: int, length: int) -> dict:
    """One record by its place."""
    held, _ = _dictionary(data)
    plain = zstandard.ZstdDecompressor(dict_data=held).decompress(data[offset : offset + length])
    return next(parse(io.BytesIO(plain)))


def read_archive(data: bytes) -> Iterator[dict]:
    """All records of a file, one frame after the other."""
    held, start = _dictionary(data)
    with zstandard.ZstdDecompressor(dict_data=held).stream_reader(data[start:], read_across_frames=True) as plain:
        yield from parse(io.BufferedReader(plain, 1 << 16))


def parse(stream) -> Iterator[dict]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        if f"sha1:{sha1_base32(block)}" != fields.get("warc-block-digest", f"sha1:{sha1_base32(block)}"):
            raise ValueError("a record's block digest is wrong")
        yield {"fields": fields, "block": block}


def _open(folder: str):
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(folder)
    except pa.ArrowInvalid:
        return fs.LocalFileSystem(), folder


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        ids: list[int | None] = []
        size = number = 0

        def close():
            nonlocal held, ids, size, number
            data, places = write_archive(held)
            file = f"{name}-{number:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{file}", compression=None) as f:
                f.write(data)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([file] * len(ids)), pa.array(ids, pa.int64()), pa.array([o for o, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())],
                names=["file", "page_id", "offset", "length"],
            )
            held, ids, size, number = [], [], 0, number + 1
            return rows

        for batch in batches:
            for r in batch.to_pylist():
                held.append(record(r["page_id"], r["url"], r["payload"] or b"", r["refers_to"], r["refers_url"], r["revisit"], date))
                ids.append(r["page_id"])
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return run


def decide(pages: DataFrame, minimum: int = 0, id_col: str = "page_id") -> DataFrame:
    """page_id, url, payload, revisit, refers_to, refers_url.  Ids are whole numbers; a null one stays null.

    Of rows with equal payloads of at least ``minimum`` bytes that with the largest id is the response (rows that repeat
    this id all are); smaller payloads are all responses.  Digests decide equality (SHA-256 with the length).
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = written(
        keyed.filter(F.octet_length("payload") >= minimum).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "copies",
    )
    joined = with_groups(keyed, groups, "digest", "n", F.unhex(F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"), 256)))
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    return joined.select("page_id", "url", "payload", again.alias("revisit"), F.when(again, F.col("last.page_id")).alias("refers_to"), F.when(again, F.col("last.url")).alias("refers_url"))


def write(pages: DataFrame, folder: str | None = None, minimum: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write the archives; returns their folder and the manifest (an index of file, page_id, offset, length).

    Null html is an empty payload, a null url gives no target header, a null page_id no id.  An empty table writes no file.
    Columns of other names are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    manifest = f"{folder}-manifest"
    decide(pages, minimum).mapInArrow(_writer(folder, archive_bytes, date), _MANIFEST).write.mode("overwrite").parquet(manifest)
    return folder, spark.read.schema(_MANIFEST).parquet(manifest)


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files that the manifest names."""
    names = manifest.select("file").distinct()
    count = names.count()
    # a file a task, up to a bound; each task opens its own files one by one, so that no archive passes a shuffle
    return names.repartition(max(1, min(count, 10_000)), "file").mapInArrow(_reader(folder, payloads), _READ)


def _reader(folder: str, payloads: bool):
    names = [f.split()[0] for f in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(data: bytes):
        for r in read_archive(data):
            f = r["fields"]
            head, _, body = r["block"].partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", head)[1])
            number = lambda k: int(f[k]) if k in f else None
            yield number("x-page-id"), f.get("warc-target-uri"), size, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], number("x-refers-to-page-id"), body if payloads and f["warc-type"] == "response" else None

    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    found = list(rows(f.read()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return run


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back; null html is an empty payload, and of equal payloads the largest page_id is the response."""
    folder, manifest = write(table(spark, sf_dir, "pages"))
    return read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of the SHA-1 hex, four groups of 40 bits
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
d AS (SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS x, g.last FROM p JOIN g ON p.h = g.h),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> (35 - 5 * j)) & 31) AS INTEGER) + 1, 1), '' ORDER BY k, j) AS digest
  FROM (SELECT page_id, k, CAST('0x' || substr(x, 1 + 10 * k, 10) AS BIGINT) AS v FROM d, range(4) AS a(k)), range(8) AS b(j) GROUP BY page_id)
SELECT d.page_id, payload_bytes, digest AS payload_digest, CASE WHEN d.page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> last THEN last END AS refers_to FROM d JOIN c ON c.page_id = d.page_id
"""
