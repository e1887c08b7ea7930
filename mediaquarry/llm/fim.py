r"""Fill-in-middle transformation over sparse checkpoints.

A text's units are counted once, over its UTF-8 bytes in pieces of ``PIECE`` bytes; every ``EVERY`` units the byte offset and
the code-point offset of the unit's start are recorded.  A cut at a unit is found by binary search among the checkpoints and
a rescan of the bytes from there to the next one.  Units are code points, or lines (each with its line feed).

The two cuts, and whether and in which order a text is rearranged, are drawn from digests of its id, so that every run, and
every retried task, gives the same examples.  A text that holds one of the sentinels stays plain, and so the original can be
told from output and form alone: no sentinel can begin in one part and end in the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

EVERY, PIECE = 4096, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts: how many are rearranged, and how many of those have the suffix first.
RATE, SPM_RATE = 90, 20


class Checkpoints:
    """Where every ``every``-th unit of a text begins, in bytes and in code points."""

    def __init__(self, raw: np.ndarray, unit: str = "char", every: int = EVERY):
        if unit not in ("char", "line"):
            raise ValueError(f"unit is char or line, not {unit}")
        self.raw, self.unit, self.every = raw, unit, every
        marks, chars_before, found, chars = [], [], 0, 0
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            first = (piece & 0xC0) != 0x80
            starts = np.flatnonzero(first if unit == "char" else self._line_starts(at, at + len(piece)))
            here = starts[(-found) % every :: every]
            if len(here):
                marks.append(here + at)
                chars_before.append(chars + (here if unit == "char" and len(starts) == len(piece) else np.cumsum(first)[here] - 1))
            found += len(starts)
            chars += int(np.count_nonzero(first))
        self.units, self.chars = found, chars
        self.bytes_at = np.concatenate(marks) if marks else np.zeros(0, np.int64)
        self.chars_at = np.concatenate(chars_before) if marks else np.zeros(0, np.int64)

    def _line_starts(self, a: int, b: int) -> np.ndarray:
        """Which bytes from a to b begin a line: the first, and those after a line feed."""
        before = self.raw[a - 1 : b - 1] if a else np.concatenate((np.full(1, 10, np.uint8), self.raw[: b - 1]))
        return before == 10

    def byte_of(self, unit: int) -> tuple[int, int]:
        """(byte offset, code-point offset) of a unit's start; of the text's end for ``units``."""
        if not 0 <= unit <= self.units:
            raise IndexError(unit)
        if unit == self.units:
            return len(self.raw), self.chars
        k = int(np.searchsorted(np.arange(len(self.bytes_at)) * self.every, unit, side="right")) - 1
        a = int(self.bytes_at[k])
        b = int(self.bytes_at[k + 1]) if k + 1 < len(self.bytes_at) else len(self.raw)
        first = (self.raw[a:b] & 0xC0) != 0x80
        starts = np.flatnonzero(first if self.unit == "char" else self._line_starts(a, b))
        at = int(starts[unit - k * self.every])
        return a + at, int(self.chars_at[k]) + int(np.count_nonzero(first[:at]))


def _transformed(unit: str, every: int):
    """Per batch: n, form, the three parts' code points, and the rearranged text."""

    def one(text: bytes, h1: int, h2: int, form: str):
        marks = Checkpoints(np.frombuffer(text, np.uint8), unit, every)
        if form == "plain":
            return marks.units, None, None, text
        low, high = sorted((h1 % (marks.units + 1), h2 % (marks.units + 1)))
        (a, prefix), (b, upto) = marks.byte_of(low), marks.byte_of(high)
        p, m, s = text[:a], text[a:b], text[b:]
        parts = (PREFIX.encode(), p, SUFFIX.encode(), s) if form == "psm" else (SUFFIX.encode(), s, PREFIX.encode(), p)
        return marks.units, prefix, upto - prefix, b"".join((*parts, MIDDLE.encode(), m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:-4]
            texts, h1, h2, forms = batch.columns[-4:]
            # a few texts at a time, so that long ones don't stand beside their outputs all at once
            size = np.cumsum(np.asarray(pc.binary_length(texts)))
            groups = np.flatnonzero(np.diff(size // PIECE, prepend=-1, append=-1))
            for lo, hi in zip(groups[:-1], groups[1:]):
                rows = [one(texts[i].as_buffer().to_pybytes(), h1[i].as_py(), h2[i].as_py(), forms[i].as_py()) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(lo, hi - lo) for c in kept], pa.array([r[0] for r in rows], pa.int64()), forms.slice(lo, hi - lo),
                        pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()),
                    ],
                    names=[*batch.schema.names[:-4], "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the digest of a seed and an id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "char", rate: int = RATE, spm_rate: int = SPM_RATE, every: int = EVERY, keep: tuple[str, ...] = ()) -> DataFrame:
    """One example a row: the id, the columns ``keep``, n (units), form (psm, spm or plain), prefix_chars, middle_chars, output.

    Null and empty texts give an empty plain example.  Prefix and middle are null in plain examples, and may be empty in
    others.  Repeated rows, equal ids and null ids all give an example each, equal ones for equal rows.  Other columns are
    not read.  A text and its output stand in memory together, once.
    """
    own = [id_col, *[c for c in keep if c != id_col]]
    clash = {c.lower() for c in own} & {"n", "form", "prefix_chars", "middle_chars", "output"}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    text, draws = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _draws(F.col(f"`{id_col}`"), seed)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < spm_rate, "spm").otherwise("psm")
    inner = [fresh(own, c) for c in ("text_", "h1", "h2", "form_")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *[c.alias(name) for c, name in zip((text.cast("binary"), draws[0], draws[1], form), inner)])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(_transformed(unit, every), f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form: what stands between the sentinels, in the order prefix, middle, suffix.

    The first sentinel opens the output; the others are the first of their kind, as the parts hold none.
    """
    s, p, m = (F.locate(x, output) for x in (SUFFIX, PREFIX, MIDDLE))
    whole, width = F.length(output), len(PREFIX)
    piece = lambda a, b: F.substring(output, a + width, b - a - width)
    tail = F.substring(output, m + width, whole)
    return F.when(form == "psm", F.concat(piece(p, s), tail, piece(s, m))).when(form == "spm", F.concat(piece(p, m), tail, piece(s, p))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all ``documents`` by code points, as digests of the output and of the text that it gives back; null texts are empty."""
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, a, b, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
