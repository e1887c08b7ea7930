"""Hidden Markov language model over words: Baum-Welch training and exact scaled forward scoring.

Counts first.  Every distinct word of a block of documents meets its corpus-wide training count once (see ``blocks``), so
that each document becomes a sequence of symbols: a word seen at least twice in training belongs to one of ``buckets``
symbols by a hash, words seen once and unknown words share the symbol RARE, and the document's end is END.  A state emits
a symbol, and the symbol emits a word: with its share of the symbol's training count.  That keeps the states' table
bounded (states x symbols, a parameter), while every word of any corpus keeps its own probability.  RARE gives an unknown
word the mass that Good and Turing's estimate has for it.  All probabilities of the words known in training and of the
one unknown word sum to one, so scores compare with the add-one unigram base.

Baum-Welch: each pass runs the scaled forward and backward recursions over all training documents, partitions return
expected counts, and their sums are the next parameters.  Long documents are cut into windows of ``TRAIN_WINDOW`` symbols
that are worked on side by side; each also reads the ``CONTEXT`` symbols before and after it, so that the forward and
backward vectors at its borders are those of the whole text but for what a state remembers over that many words (tests
hold the counts against whole texts), and every transition is counted once, those over borders too.  Scoring runs the
scaled forward recursion over each whole text.

How much the states' emissions are drawn to the symbols' shares of the corpus (the prior, in tokens: multiples of the number
of symbols in use) and how many passes are good is told by a fold of the training texts, one in ``FOLD``, that is left out
of the counts: of all passes and weights looked at, the model under which the fold is likeliest is kept.  The model that
scores has one state more, which a text enters at its start or never, doesn't leave, and which emits symbols by their shares of
the corpus: so what the states learnt is of no harm to a text that is not like what they were learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import crc32_of, stored, table, with_groups, written

STATES, BUCKETS, PASSES, TRAIN_WINDOW, CONTEXT = 8, 1 << 15, 6, 384, 32
BLOCK_BYTES, SCORED_AT_ONCE = 8 << 20, 1 << 20
FOLD, WEIGHTS = 12, (1 / 512, 0.5, 64.0)
BACKGROUND = 0.5  # the chance that a text is one of the state that is never left
#: Partial sums of a pass are added up in steps: this many tables, then so many, then one.
STEPS = (4096, 64)
END, RARE, FIRST = 0, 1, 2
_FACTS = "held_out boolean, n_tokens long, n_known long, base_sum double, word_sum double, symbols binary"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split cuts at the contract's six white-space bytes."""
    return text.encode().lower().split() if text else []


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has; the same words as ``words_of``, without Python objects."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    flat = lists.flatten()
    whole = np.diff(lists.offsets.to_numpy())
    real = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves empty parts
    seen = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(whole)
    return flat.filter(real), seen[ends] - seen[ends - whole]


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table.column(name).type)


def _ask(rows: pa.Table) -> pa.Table:
    """A block's distinct words with their counts in its training rows, gathered chunk by chunk."""
    block, parts = rows.column("block")[0].as_py(), []
    for docs in blocks.chunks(rows):
        words, sizes = tokens_of(_column(docs, "text"))
        held = np.repeat(_column(docs, "held_out").to_numpy(zero_copy_only=False), sizes)
        trained, other = pc.value_counts(words.filter(pa.array(~held))), pc.unique(words.filter(pa.array(held)))
        parts.append(pa.table({"word": trained.field("values"), "n": trained.field("counts")}))
        parts.append(pa.table({"word": other, "n": pa.array(np.zeros(len(other), np.int64))}))
        if len(parts) >= 16:
            parts = [_summed(parts)]
    out = _summed(parts)
    return pa.table({"block": pa.array(np.full(len(out), block, np.int32)), "word": out.column("word").cast(pa.string()), "n": out.column("n")})


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _symbols(total: int, distinct: int, once: int, twice: int, trained_ends: int, mass: np.ndarray):
    """Per block: each document's symbols and what its words add to the score beside the states."""
    unseen, single = max(once, 1), 2 * twice
    # shares of RARE: the unknown word, and each word seen once
    share_unknown = math.log10(unseen / (unseen + single)) if once else 0.0
    share_single = math.log10(single / (unseen + single) / once) if once and twice else -math.inf

    lowest = math.log10(total + distinct + 1)
    end_base = math.log10(trained_ends + 1) - lowest

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known_words = _column(answers, "word").cast(pa.large_string())
        count = answers.column("c").to_numpy()
        bucket = answers.column("bucket").to_numpy()
        base, known = np.log10(count + 1.0) - lowest, (count > 0).astype(np.int64)
        often = count >= 2
        symbol = np.where(often, bucket, RARE).astype(np.uint16)
        inner = np.where(often, np.log10(np.maximum(count, 1) / mass[np.where(often, bucket, END)]), np.where((count == 1) & math.isfinite(share_single), share_single, share_unknown))
        return pa.concat_tables([coded(docs, known_words, base, known, symbol, inner) for docs in blocks.chunks(rows)])

    def coded(docs: pa.Table, known_words: pa.Array, base, known, symbol, inner) -> pa.Table:
        words, sizes = tokens_of(_column(docs, "text"))
        at = pc.index_in(words, value_set=known_words).to_numpy()
        del words
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)

        def summed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(sizes), values.dtype)
            if len(full):
                out[full] = np.add.reduceat(values[at], (ends - sizes)[full])
            return out

        codes = np.full(len(at) + len(sizes), END, np.uint16)
        borders = np.zeros(len(codes), bool)
        borders[ends + np.arange(len(sizes))] = True
        codes[~borders] = symbol[at]
        offsets = np.concatenate(([0], 2 * (ends + np.arange(1, len(sizes) + 1)))).astype(np.int32)
        symbols = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
        return pa.table({
            "doc_id": _column(docs, "id"), "held_out": _column(docs, "held_out"), "n_tokens": pa.array(sizes + 1, pa.int64()), "n_known": pa.array(summed(known) + (trained_ends > 0)),
            "base_sum": pa.array(summed(base) + end_base), "word_sum": pa.array(summed(inner)), "symbols": symbols,
        })

    return run


class Hmm:
    """Start (K), transition (K x K) and emission (symbols x K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, frequencies: np.ndarray, states: int, seed: int = 1) -> Hmm:
        """States that differ at random around the symbols' frequencies, and tend to stay."""
        draw = np.random.default_rng(seed)
        emit = (frequencies + 1e-3)[:, None] * draw.gamma(1.0, size=(len(frequencies), states))
        move = np.full((states, states), 0.3 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.7)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float) -> Hmm:
        """Maximum a posteriori: the states' emissions share the symbols' frequencies as a prior worth ``weight`` tokens."""
        emit = emit + weight * prior[:, None]
        return cls((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))

    def with_background(self, prior: np.ndarray, chance: float = BACKGROUND) -> Hmm:
        """With a further, last state that is entered at the start only, never left, and emits by the symbols' shares."""
        k = len(self.start)
        move = np.eye(k + 1)
        move[:k, :k] = self.move
        return Hmm(np.append(self.start * (1 - chance), chance), move, np.column_stack((self.emit, prior)))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each symbol sequence, by the scaled forward recursion over sequences in step."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order], dtype=np.int64)
        out = np.zeros(len(sequences))
        if not len(order) or not lengths[0]:
            return out
        starts = np.concatenate(([0], np.cumsum(lengths[:-1])))
        flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
        logs = np.zeros(len(order))
        live = int(np.searchsorted(-lengths, 0, side="left"))
        alpha = np.repeat(self.start[None, :], live, 0)
        for t in range(int(lengths[0])):
            now = int(np.searchsorted(-lengths, -t, side="left"))  # longer than t
            alpha = (alpha[:now] @ self.move if t else alpha[:now]) * self.emit[flat[starts[:now] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            logs[:now] += np.log10(scale)
        out[order] = logs
        return out

    def expected(self, windows: np.ndarray, lengths: np.ndarray, own: np.ndarray, fresh: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Adds expected counts of windows (N x T symbols, sorted by falling length) to ``sums``; returns their log10.

        ``own`` (T x N): the symbols that a window counts; the others are context.  ``fresh``: windows at a text's start.
        """
        start, move, emit = sums
        n, top = windows.shape
        k = len(self.start)
        emission, step = self.emit.astype(np.float32), self.move.astype(np.float32)
        first = np.where(fresh[:, None], self.start, self.usual()).astype(np.float32)
        alphas, scales = np.zeros((top, n, k), np.float32), np.ones((top, n), np.float32)
        live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(top + 1)]  # windows longer than t
        total = 0.0
        for t in range(top):
            now = live[t]
            alpha = (alphas[t - 1, :now] @ step if t else first[:now]) * emission[windows[:now, t]]
            scale = alpha.sum(1)
            np.divide(alpha, scale[:, None], out=alphas[t, :now])
            scales[t, :now] = scale
            total += float(np.log10(scale[own[t, :now]]).sum(dtype=np.float64))
        beta = np.ones((n, k), np.float32)
        for t in range(top - 1, -1, -1):
            after = live[t + 1]
            if after:
                ahead = emission[windows[:after, t + 1]] * beta[:after] / scales[t + 1, :after, None]
                move += (alphas[t, :after].T @ (ahead * own[t + 1, :after, None])) * self.move
                beta[:after] = ahead @ step.T
            alphas[t, : live[t]] *= beta[: live[t]]  # from here on the share of each state
        start += alphas[0][fresh].sum(0)
        which = windows.T[own]
        for s in range(k):
            emit[:, s] += np.bincount(which, weights=alphas[:, :, s][own], minlength=len(emit))
        return total

    def usual(self) -> np.ndarray:
        """The share of each state far from any border."""
        share = np.full(len(self.start), 1 / len(self.start))
        for _ in range(64):
            share = share @ self.move
        return share


def windows_of(sequences: Iterable[np.ndarray], size: int, context: int) -> Iterator[tuple[np.ndarray, int, int, bool]]:
    """(symbols, context before, own symbols, at the start) of each window; the own parts are the whole sequence."""
    for s in sequences:
        for a in range(0, len(s), size):
            before = min(a, context)
            yield s[a - before : a + size + context], before, min(size, len(s) - a), a == before


def _count(model, train_window: int, size: int, chunk: int = 1024, context: int = CONTEXT):
    """A partition's expected counts, as one row a state."""

    def run(batches):
        hmm = model.value
        k = len(hmm.start)
        sums = (np.zeros(k), np.zeros((k, k)), np.zeros((size, k)))
        total, any_row = 0.0, False
        for batch in batches:
            parts = list(windows_of((np.frombuffer(raw.as_buffer(), np.uint16) for raw in batch.column("symbols")), train_window, context))
            order = sorted(range(len(parts)), key=lambda i: -len(parts[i][0]))
            for c in range(0, len(order), chunk):
                some = [parts[i] for i in order[c : c + chunk]]
                lengths = np.array([len(p[0]) for p in some], np.int64)
                grid = np.zeros((len(some), int(lengths[0])), np.int64)
                for r, p in enumerate(some):
                    grid[r, : lengths[r]] = p[0]
                before, mine = np.array([p[1] for p in some]), np.array([p[2] for p in some])
                place = np.arange(int(lengths[0]))[:, None]
                own = (place >= before) & (place < before + mine)
                total += hmm.expected(grid, lengths, own, np.array([p[3] for p in some]), sums)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(k), pa.int32()), pa.array([sums[0][i : i + 1].tobytes() + sums[1][i].tobytes() for i in range(k)], pa.binary()),
                    pa.array([np.ascontiguousarray(sums[2][:, i]).astype(np.float32).tobytes() for i in range(k)], pa.binary()), pa.array([total / k] * k),
                ],
                names=["state", "small", "emit", "total"],
            )

    return run


def _add(rows: pa.Table) -> pa.Table:
    small = sum(np.frombuffer(x.as_buffer(), np.float64) for x in rows.column("small"))
    emit = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows.column("emit"))
    return pa.table({"state": rows.column("state").slice(0, 1), "small": pa.array([small.tobytes()], pa.binary()), "emit": pa.array([emit.astype(np.float32).tobytes()], pa.binary()), "total": pa.array([float(sum(rows.column("total").to_pylist()))])})


_SUMS = "state int, small binary, emit binary, total double"


def one_pass(encoded: DataFrame, model: Hmm, train_window: int, size: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """Expected counts (starts, moves, emissions) of all rows under the model, and the model's log10 of the windows."""
    spark, k = encoded.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    counts = encoded.select("symbols").mapInArrow(_count(shared, train_window, size), _SUMS)
    # added up in steps, so that no task gets every partition's table
    part = counts.withColumn("part", F.spark_partition_id())
    for fewer in STEPS:
        part = part.groupBy("state", F.pmod("part", F.lit(fewer)).alias("group")).applyInArrow(_added, f"{_SUMS}, part int")
    rows = part.drop("part").groupBy("state").applyInArrow(_add, _SUMS).collect()
    shared.unpersist()
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for r in rows:
        small = np.frombuffer(bytes(r["small"]), np.float64)
        start[r["state"]], move[r["state"]], emit[:, r["state"]] = small[0], small[1:], np.frombuffer(bytes(r["emit"]), np.float32)
    return (start, move, emit), sum(r["total"] for r in rows)


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    return _add(rows.drop_columns(["part"])).append_column("part", pa.array([key[1].as_py()], pa.int32()))


def likelihoods(encoded: DataFrame, models: list[Hmm]) -> list[float]:
    """The log10 probability of all symbols of ``encoded`` under each model."""
    shared = encoded.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        sums = np.zeros(len(shared.value))
        for batch in batches:
            for part in _parts(batch.column("symbols")):
                sums += [m.log10(part).sum() for m in shared.value]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["model", "total"])

    found = encoded.select("symbols").mapInArrow(run, "model int, total double").groupBy("model").agg(F.sum("total").alias("total")).collect()
    shared.unpersist()
    told = {r["model"]: r["total"] for r in found}
    return [told.get(i, 0.0) for i in range(len(models))]


def _parts(symbols: pa.Array) -> Iterator[list[np.ndarray]]:
    """A batch's sequences, a bounded number of symbols (or one sequence) at a time."""
    ends = np.cumsum(pc.binary_length(symbols).to_numpy()) // 2
    groups = np.flatnonzero(np.diff(ends // SCORED_AT_ONCE, prepend=0, append=-1))  # where a new part of the batch begins
    for a, b in zip([0, *groups.tolist()], [*groups.tolist(), len(symbols)]):
        if a < b:
            yield [np.frombuffer(s.as_buffer(), np.uint16) for s in symbols.slice(a, b - a)]


def encode(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict, np.ndarray]:
    """Symbols of every document (a written table), the corpus' totals, and the symbols' training frequencies."""
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out")))
    dealt = blocks.deal(rows, "text", block_bytes)
    asked = written(blocks.words_by_block(dealt, _ask, "block int, word string, n long"), "asked")
    words = written(asked.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")), "words")
    bucket = (F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(buckets)) + FIRST).cast("int")
    symbol = F.when(F.col("c") >= 2, bucket).otherwise(RARE)
    each = words.filter("c > 0").groupBy(symbol.cast("int").alias("symbol")).agg(F.sum("c").alias("mass"), F.count(F.lit(1)).alias("words"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("twice")).collect()
    ends = rows.filter("NOT held_out").count()
    frequencies = np.zeros(buckets + FIRST)
    for r in each:
        frequencies[r["symbol"]] = r["mass"]
    once = int(frequencies[RARE])
    totals = {"words": sum(r["words"] for r in each), "tokens": int(frequencies.sum()) + ends, "once": once, "twice": sum(r["twice"] for r in each), "ends": ends}
    frequencies[END] = ends
    totals["distinct"] = totals["words"] + (ends > 0)
    mass = np.maximum(frequencies, 1)
    work = _symbols(totals["tokens"], totals["distinct"], once, totals["twice"], ends, mass)
    # words that very many blocks ask for are broadcast, the rest meets its count by shuffle
    loose = F.concat(F.col("block").cast("string"), F.lit("\0"), "word")
    answers = with_groups(asked.select("block", "word"), words, "word", "blocks", loose).select("block", "word", "c", bucket.alias("bucket"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_FACTS}"
    return written(blocks.per_block(dealt, answers, work, schema), "symbols"), totals, frequencies


def train(encoded: DataFrame, frequencies: np.ndarray, states: int = STATES, passes: int = PASSES, train_window: int = TRAIN_WINDOW, weights: tuple[float, ...] = WEIGHTS) -> tuple[Hmm, list[float]]:
    """The likeliest model on the fold, and the log10 of the counted windows before each pass.

    The passes go on from the lightest prior; every second one, and the last, is also tried with the heavier ones.
    """
    total, used = frequencies.sum(), max(1, int(np.count_nonzero(frequencies)))
    prior = (frequencies + 1e-3) / (total + 1e-3 * len(frequencies))
    kept = F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(FOLD)) != 0
    rows = encoded.filter("NOT held_out")
    counted, fold = rows.filter(kept), rows.filter(~kept)
    model, progress, best = Hmm.first(prior, states), [], (-math.inf, None)
    for n in range(passes):
        sums, reached = one_pass(counted, model, train_window, len(prior))
        progress.append(reached)
        models = [Hmm.from_counts(*sums, prior, w * used) for w in weights]
        model = models[0]
        if n % 2 or n == passes - 1:
            tried = [m.with_background(prior) for m in models[::-1]]  # without a fold the heaviest prior is the safest
            best = max(best, *zip(likelihoods(fold, tried), tried), key=lambda x: x[0])
    return best[1] or model.with_background(prior), progress


def score(encoded: DataFrame, model: Hmm, totals: dict) -> DataFrame:
    """Each document's exact log10 probability, beside the add-one unigram base."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    tokens = totals["tokens"]

    def run(batches):
        for batch in batches:
            found = [shared.value.log10(part) for part in _parts(batch.column("symbols"))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), batch.column("n_known"), pa.array(np.full(len(batch), tokens, np.int64)), batch.column("base_sum"), pa.array(score + batch.column("word_sum").to_numpy())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Train on the rows that are not ``held_out`` (a boolean column) and score all rows.

    Null and empty texts have the end token alone.  Repeated rows and ids all count and are all returned; ids may be of any
    type, and a null id stays null.  An empty table, or one without training rows, gives a model of one unknown word, and scores all the same.
    Columns of other names are not read.
    """
    encoded, totals, frequencies = encode(docs, held_out, id_col, text_col)
    model, _ = train(encoded, frequencies, states, passes)
    return score(encoded, model, totals)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from those whose id's CRC-32 leaves no 2 by 7; null texts are the end token alone, repeated rows score alike."""
    return language_model(table(spark, sf_dir, "documents"), F.pmod(crc32_of("doc_id"), F.lit(7)) == 2)
