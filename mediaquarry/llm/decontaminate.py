"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the documents' token windows.

The benchmark is the stated query set.  It is read in blocks of a bounded number of bytes (``block_bytes``); each block's
windows become one broadcast set, and the documents pass it in one narrow step, without a shuffle, so that no worker ever
holds more than one set.  With more than one block a pass keeps nothing but the hits: a key of the document, its hit
positions and items.  Those of all blocks are put together by key and joined to the documents once, at the end; texts
are never written between passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, row_place, stored, table, text_bytes, written

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of benchmark text in one broadcast set: some hundred MB of windows on a worker at most
#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space; bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class WindowSet:
    """The windows of one block of items, by length, as ids of the block's own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            length = min(window, len(ids))
            at = self.by_length.setdefault(length, {}) if length else {}
            for i in range(len(ids) - length + 1 if length else 0):
                owners = at.setdefault(ids[i : i + length].tobytes(), [])
                if str(item) not in owners:
                    owners.append(str(item))
        self.sums = {n: np.unique(self._rolled(np.frombuffer(b"".join(at), np.int32), n)[::n]) for n, at in self.by_length.items()}

    @staticmethod
    def _rolled(ids: np.ndarray, length: int) -> np.ndarray:
        """A hash of each window of so many ids; equal windows have equal hashes, hits are verified afterwards."""
        out = np.zeros(max(0, len(ids) - length + 1), dtype=np.uint64)
        wide = ids.astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                out = out * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + len(out)]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside a window that occurs, and the items of those windows."""
        hit = np.zeros(len(words), dtype=bool)
        items: set[str] = set()
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words], dtype=np.int32)
        seen = np.concatenate(([0], np.cumsum(ids != 0)))
        for length, at in self.by_length.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(seen[length:] - seen[:-length] == length)
            if not len(full):
                continue
            sums = self._rolled(ids, length)[full]
            for i in full[np.isin(sums, self.sums[length])]:
                owners = at.get(ids[i : i + length].tobytes())
                if owners:
                    hit[i : i + length] = True
                    items.update(owners)
        return hit, items


def n_blocks(benchmark: DataFrame, block_bytes: int, text: str = "text") -> int:
    return max(1, -(-text_bytes(benchmark, text) // block_bytes))


def blocks_of(benchmark: DataFrame, block_bytes: int, item: str = "item_id", text: str = "text") -> Iterator[list]:
    """The items in blocks of about ``block_bytes`` of text; only one block is on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    count = n_blocks(rows, block_bytes)
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"] or "", r["text"]) for r in part.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with two more columns: ``hit_words`` (a byte per word, 1 if hit) and ``hit_items`` (sorted item ids).

    An item shorter than the window is one window; an item or document without words has none.  Null text: no words.
    Equal items are all reported, and repeated documents each have their hits.  If ``docs`` has columns of these names, the
    new ones get leading underscores.
    """
    if not len(docs.columns):
        raise ValueError("documents without columns")
    bits, items = fresh(docs.columns, "hit_words"), fresh(docs.columns, "hit_items")
    schema = docs.withColumns({bits: F.lit(None).cast("binary"), items: F.lit(None).cast("array<string>")}).schema
    spark = docs.sparkSession
    if n_blocks(benchmark, block_bytes) == 1:
        windows = spark.sparkContext.broadcast(WindowSet(next(blocks_of(benchmark, block_bytes)), window))
        return docs.mapInArrow(_pass(windows, text_col, bits, items), schema)
    docs = stored(docs)
    row = fresh(schema.names, "row")
    numbered = docs.withColumn(row, _row(text_col))
    parts = None
    for block in blocks_of(benchmark, block_bytes):
        windows = spark.sparkContext.broadcast(WindowSet(block, window))
        part = written(numbered.select(row, F.col(f"`{text_col}`").alias("text")).toDF("row", "text").mapInArrow(_hits_alone(windows), _HITS), "hits")
        windows.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    # a document has a row of hits for each block at most
    found = parts.groupBy("row").agg(F.collect_list("hits").alias(bits), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items)).withColumnRenamed("row", row)
    whole = numbered.join(found, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], bits, items)
    return whole.mapInArrow(_together(text_col, bits, items), schema)


def _row(text_col: str) -> Column:
    """A stored document's key: its place, and its text for plans that make several rows of one."""
    return F.struct(row_place().alias("place"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"))


_HITS = "row struct<place: bigint, text: bigint>, hits binary, items array<string>"


def _hits_alone(shared):
    """The documents that have a hit, without their texts."""

    def run(batches):
        windows = shared.value
        for batch in batches:
            at, hits, items = [], [], []
            for k, text in enumerate(batch.column("text")):
                hit, own = windows.scan(words_of(text.as_py()))
                if own:
                    at.append(k)
                    hits.append(hit.tobytes())
                    items.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["row", "hits", "items"])

    return run


def _together(text_col: str, bits: str, items: str):
    """The hits of all blocks in one; zeros for documents without any."""

    def run(batches):
        for batch in batches:
            hits, names = [], []
            for text, arrays, own in zip(batch.column(text_col), batch.column(bits).to_pylist(), batch.column(items).to_pylist()):
                hits.append(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in arrays]).tobytes() if arrays else bytes(len(words_of(text.as_py()))))
                names.append(sorted(own or ()))
            columns = {n: batch.column(n) for n in batch.schema.names} | {bits: pa.array(hits, pa.binary()), items: pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _pass(shared, text_col: str, bits: str, items: str):
    def run(batches):
        windows = shared.value
        for batch in batches:
            hits, found = [], []
            for text in batch.column(text_col):
                hit, own = windows.scan(words_of(text.as_py()))
                hits.append(hit.tobytes())
                found.append(sorted(own))
            columns = {n: batch.column(n) for n in batch.schema.names} | {bits: pa.array(hits, pa.binary()), items: pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The counts of each document, without its text.  Ids are whole numbers; a null id stays null."""
    found = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col("text").alias("text")), benchmark, window=window, block_bytes=block_bytes)
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _digest(batches):
    for batch in batches:
        hits = [h.as_py() for h in batch.column("hit_words")]
        items = batch.column("hit_items").to_pylist()
        counts = [h.count(1) for h in hits]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(counts, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([c > 0 for c in counts]),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "document", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove what the benchmark has: whole documents, or only the hit spans (``mode="span"``).

    The columns stay as they are.  By span, the text from the first to the last word of each hit run goes, and again until
    no window is left, as what comes together may form a window anew; the rest is joined by a line feed.
    """
    if mode == "document":
        found = find_hits(docs, benchmark, text_col, window, block_bytes)
        bits = found.columns[-2]
        return found.filter(F.instr(F.hex(bits), "01") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if mode != "span":
        raise ValueError("mode is 'document' or 'span'")
    blocks = n_blocks(benchmark, block_bytes)
    out, clean = docs, None
    if blocks > 1:  # only documents with a hit are rewritten, block after block
        row = fresh(docs.columns, "row")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = find_hits(numbered.select(row, F.col(f"`{text_col}`").alias("text")), benchmark, "text", window, block_bytes)
        dirty = written(found.filter(F.size("hit_items") > 0).select(row), "dirty")
        clean = numbered.join(dirty, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
        out = written(numbered.join(dirty, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]), "cut")
    while True:
        before = out
        for block in blocks_of(benchmark, block_bytes):
            out = out.mapInArrow(_cut(docs.sparkSession.sparkContext.broadcast(WindowSet(block, window)), text_col), docs.schema)
            out = written(out, "cut") if blocks > 1 else out
        # what a later block cuts may bring a window of an earlier one together: again until nothing changes
        if blocks == 1 or before.select(F.sum(F.length(f"`{text_col}`"))).first()[0] == out.select(F.sum(F.length(f"`{text_col}`"))).first()[0]:
            return out if clean is None else out.unionByName(clean)


def _cut(shared, text_col: str):
    def run(batches):
        windows = shared.value
        for batch in batches:
            texts = [_without(windows, t.as_py()) for t in batch.column(text_col)]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return run


def _without(windows: WindowSet, text: str | None) -> str | None:
    while text:
        raw = text.encode()
        folded = raw.translate(FOLD)
        words = folded.split()
        hit, _ = windows.scan(words)
        if not hit.any():
            return text
        spans, at = [], 0
        for word in words:
            at = folded.index(word, at)
            spans.append((at, at + len(word)))
            at += len(word)
        kept, k, start = [], 0, 0
        while k < len(words):
            if hit[k]:
                kept.append(raw[start : spans[k][0]])
                while k < len(words) and hit[k]:
                    k += 1
                start = spans[k - 1][1]
            else:
                k += 1
        kept.append(raw[start:])
        text = b"\n".join(p for p in kept if p.strip()).decode()
    return text


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all ``documents``; null texts have no words, items without words hit nothing, repeated items each count by their id."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, dw.l, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(q.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(q.names, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""
