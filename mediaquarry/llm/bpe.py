"""BPE encoding and decoding through a table of distinct words.

The pre-tokeniser's words are found in Spark tasks, and blocks of documents (see ``blocks``) ask for their distinct words.
What they ask is sorted by word, and each task walks its sorted range: it encodes every word once and answers the blocks
in packed rows, so that no list is kept of the blocks that have a word, however common it is.  Ids then are joined back by
position.  Decoding joins the distinct ids of a block or batch to the table of the vocabulary's pieces, whose number is
the vocabulary's size, and puts the pieces' bytes back by position.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .common import stored, table

VOCABULARY = "byte_bpe_50k.json"
# The pre-tokeniser's pattern is a fixed value of the vocabulary's format.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _classes(last: int) -> tuple[str, str, str]:
    """Letters, numbers and white space up to a code point, as character classes."""
    names = (r"\p{L}", r"\p{N}", r"\s")
    return tuple("".join(re.escape(chr(c)) for c in range(last + 1) if regex.match(n, chr(c))) for n in names)


_LAST = 0x24F
_L, _N, _S = _classes(_LAST)
#: The same pattern with the classes written out, for texts without code points above _LAST: several times faster.
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_HIGH = re.compile(rf"[^\x00-ɏ]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def _specials(path: str) -> tuple[dict[str, int], object]:
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return added, regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character: the format's fixed rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Table:
    """(id, piece): the bytes of each id of the vocabulary."""
    own, to_byte = _tokenizer(path).get_vocab(with_added_tokens=True), byte_of_char()
    specials = _specials(path)[0]
    rows = sorted((i, token) for token, i in own.items())
    known = [bytes(to_byte[c] for c in t) if t not in specials and all(c in to_byte for c in t) else t.encode() for _, t in rows]
    return pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": pa.array(known, pa.binary())})


class Pieces:
    """The pieces of some ids: their distinct ids joined to the vocabulary's table, and looked up by position."""

    def __init__(self, ids: np.ndarray, path: str):
        distinct = pa.table({"id": pa.array(np.unique(ids).astype(np.int32))})
        # an id that the vocabulary hasn't has no piece, and decodes to nothing
        found = distinct.join(pieces(path), "id", join_type="left outer").sort_by("id").combine_chunks()
        self.ids = found.column("id").to_numpy()
        self.bytes = pc.fill_null(found.column("piece"), b"").combine_chunks()
        self.place = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int32)
        self.place[self.ids] = np.arange(len(self.ids))

    def text(self, ids: np.ndarray) -> str:
        return _bytes_of(self.bytes.take(pa.array(self.place[ids]))).decode("utf-8", "replace") if len(ids) else ""


def split_words(text: str, path: str) -> list[str]:
    """The pre-tokeniser's words; a special token's string is a word of its own."""
    specials, cut = _specials(path)
    find = _PATTERN.findall if _HIGH.search(text) else _FAST.findall
    if cut is None or not any(s in text for s in specials):
        return find(text)
    out: list[str] = []
    for part in cut.split(text):
        out += [part] if part in specials else find(part)
    return out


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word, little-endian unsigned 32-bit; each word is encoded once, many in one call."""
    specials, _ = _specials(path)
    tok = _tokenizer(path)
    out: list[bytes] = []
    for k in range(0, len(words), 4096):
        some = words[k : k + 4096]
        done = tok.encode(["" if w in specials else w for w in some], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, dtype="<u4")
        ends = np.searchsorted(np.array([-1 if w is None else w for w in done.word_ids], dtype=np.int64), np.arange(len(some)), side="right")
        start = 0
        for w, end in zip(some, ends.tolist()):
            out.append(np.uint32(specials[w]).astype("<u4").tobytes() if w in specials else ids[start:end].tobytes())
            start = end
    return out


def _sorted_words(rows: pa.Table, path: str) -> list[str]:
    """A block's distinct words in order: a word's place is its code, whatever order the rows came in."""
    found: set[str] = set()
    for part in blocks.unpack(rows):
        for text in part.column("text"):
            found.update(split_words(text.as_py() or "", path))
    return sorted(found)


def _ask(path: str):
    def run(rows: pa.Table) -> pa.Table:
        words = _sorted_words(rows, path)
        block = rows.column("block")[0].as_py()
        return pa.table({"place": pa.array(np.arange(len(words), dtype=np.int64) + (block << 32)), "word": pa.array(words, pa.string())})

    return run


def _pack_answer(codes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending codes, each code's number of ids, the ids; compressed if that helps."""
    raw = b"".join((np.uint32(len(codes)).tobytes(), np.diff(codes, prepend=0).astype("<u4").tobytes(), counts.astype("<u4").tobytes(), ids.astype("<u4").tobytes()))
    # bytes of equal weight side by side: most are zero
    planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(planes, 3)


def _unpack_answer(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(piece), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    n = int(values[0])
    return np.cumsum(values[1 : n + 1].astype(np.int64)), values[n + 1 : 2 * n + 1].astype(np.int64), values[2 * n + 1 :]


ROWS_PACKED = 1 << 19  # asked words whose answers go out together


def _encode(path: str):
    """Walks rows sorted by word: each distinct word is encoded once, and the blocks that asked get packed answers."""

    def run(batches):
        last, last_ids = None, b""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = words[1:] if words[0] == last else words  # a word's run may go on from the batch before
            raw = encode_words(fresh, path)
            raw = [last_ids, *raw] if len(fresh) < len(words) else raw
            last, last_ids = words[-1], raw[-1]
            size = np.array([len(r) // 4 for r in raw], np.int64)
            number = coded.indices.to_numpy()
            held.append((batch.column("place").to_numpy(), size[number], (np.cumsum(size) - size)[number], np.frombuffer(b"".join(raw), "<u4")))
            rows += len(batch)
            if rows >= ROWS_PACKED:
                yield from _answers(held)
                held, rows = [], 0
        yield from _answers(held)

    return run


def _answers(held: list[tuple[np.ndarray, ...]]):
    """One row a block with the ids of the words that it asked for."""
    if not held:
        return
    base = np.cumsum([0, *(len(h[3]) for h in held[:-1])])
    places, size = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    first, flat = np.concatenate([h[2] + b for h, b in zip(held, base.tolist())]), np.concatenate([h[3] for h in held])
    order = np.argsort(places, kind="stable")
    block, code = places >> 32, places & 0xFFFFFFFF
    ends = np.flatnonzero(np.append(np.diff(block[order]) != 0, True)) + 1
    out, start = [], 0
    for end in ends.tolist():
        some = order[start:end]
        n = size[some]
        at = np.arange(n.sum()) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        out.append((int(block[order[start]]), _pack_answer(code[some], n, flat[at])))
        start = end
    for k in range(0, len(out), 4096):
        some = out[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["block", "answer"])


def word_table(dealt: DataFrame, path: str) -> DataFrame:
    """(block, answer): every distinct word of the corpus, encoded once, packed for the blocks that have it.

    A block asks for a word once, so that no word has more rows than there are blocks.
    """
    asked = blocks.words_by_block(dealt, _ask(path), "place long, word string")
    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(path), "block int, answer binary")


def _join_back(path: str, digest: bool, id_type: pa.DataType):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        number: dict[str, int] = {}
        docs: list[tuple[object, np.ndarray]] = []
        for part in blocks.unpack(rows):
            for doc, text in zip(part.column("id").to_pylist(), part.column("text")):
                words = split_words(text.as_py() or "", path)
                docs.append((doc, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))))
        place = np.zeros(len(number), np.int64)  # from the order of first use to a word's code
        place[np.fromiter((number[w] for w in sorted(number)), np.int64, len(number))] = np.arange(len(number))
        lengths, got = np.zeros(len(number), np.int64), []
        for piece in answers.column("answer"):
            codes, counts, ids = _unpack_answer(piece.as_py())
            lengths[codes] = counts
            got.append((codes, counts, ids))
        offsets = np.cumsum(lengths) - lengths
        all_ids = np.zeros(int(lengths.sum()), "<u4")
        for codes, counts, ids in got:
            all_ids[np.arange(len(ids)) + np.repeat(offsets[codes] - (np.cumsum(counts) - counts), counts)] = ids
        del got
        known = Pieces(all_ids, path)
        doc_ids, counts_out, ids_out, text_out = [], [], [], []
        for doc, used in docs:
            codes = place[used]
            n = lengths[codes]
            # positions of every word's ids, one after the other
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = all_ids[np.arange(total) + np.repeat(offsets[codes] - (ends - n), n)]
            plain = known.text(ids)
            doc_ids.append(doc)
            counts_out.append(total)
            if digest:
                ids_out.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_out.append(hashlib.sha256(plain.encode()).hexdigest())
            else:
                ids_out.append(ids.astype(np.int32))
                text_out.append(plain)
        first, second = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
        return pa.table({"doc_id": pa.array(doc_ids, id_type), "n_tokens": pa.array(counts_out, pa.int64()), first: pa.array(ids_out, pa.string() if digest else pa.list_(pa.int32())), second: pa.array(text_out, pa.string())})

    return run


def _bytes_of(values: pa.Array) -> bytes:
    data = values.buffers()[2]
    if not len(values) or data is None:
        return b""
    ends = np.frombuffer(values.buffers()[1], np.int32)
    return data.to_pybytes()[ends[values.offset] : ends[values.offset + len(values)]]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (or, with ``digest``, their SHA-256).

    Null and empty texts have no ids and decode to the empty text.  Rows that repeat an id, or all of a row, are all
    returned; ids may be of any type, and a null id stays null.  Special tokens' strings in a text are encoded as those
    tokens, as the library does by default.  Other columns are not read, whatever their names.  An empty table gives an
    empty result.
    """
    path = path or default_path()
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    dealt = blocks.deal(rows, "text", block_bytes)
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return blocks.per_block(dealt, word_table(dealt, path), _join_back(path, digest, to_arrow_type(kind)), schema)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids: distinct ids are joined to their pieces, which go back by position.

    Malformed UTF-8 is replaced, ids outside the vocabulary and null ids decode to nothing, null arrays stay null.
    """
    path = path or default_path()

    def run(batches):
        for batch in batches:
            lists = batch.column(ids_col)
            flat = lists.flatten().drop_null().to_numpy(zero_copy_only=False)
            known = Pieces(flat[flat >= 0], path)
            texts = [None if x is None else known.text(np.array([i for i in x if i is not None and i >= 0], np.int64)) for x in lists.to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names} | {out: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return encoded.mapInArrow(run, encoded.withColumn(out, F.lit(None).cast("string")).schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all ``documents``; null texts are empty and have no ids."""
    return encode(table(spark, sf_dir, "documents"), digest=True)
