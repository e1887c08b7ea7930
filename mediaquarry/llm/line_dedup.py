"""Line deduplication with a distributed suffix array over line ids.

The documents' lines that hold words, in order of document and line, form one sequence; between documents lies a border
that no run crosses.  A line's id is its rank among the lines that occur more than once.  Prefix doubling ranks the
suffixes by their first 2, 4, 8 ... lines: rows of (rank, rank 2^k further on) are sorted by a range partition with running
sums, and a suffix whose prefix occurs once leaves.  The suffixes that share their first L lines are an interval of the
suffix array in which the longest common prefix is L or more; two ranks name it, of its first and of its last 2^k lines.

A repeated run counts from ``min_words`` words.  The intervals of interest are those of the shortest runs of that many
words, from each line and up to each line: an interval's later members are copies.  Copies that overlap or touch are
merged document by document, and what comes out are the maximal repeated runs, however long they are: a longer run is a
chain of such shortest ones, and each of its lines begins, ends or lies inside one.  So ranks are needed to the depth of
the longest of the *shortest* runs (``min_words`` lines at most), and copies of any length cost no further round; tests
hold this against brute force for runs far beyond that depth, in one text and across texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_groups, written

MIN_WORDS = 50
_FOUND = "gone array<int>, stays array<boolean>"


def running(df: DataFrame, order: list[str], size: str, out: str, label: str) -> DataFrame:
    """Adds the sum of ``size`` over all rows before each row in the given order (a written table)."""

    def run(batches):
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + so_far
            columns = [*batch.columns, pa.array(ends - sizes), pa.array(np.full(len(batch), part, np.int32))]
            so_far = int(ends[-1]) if len(ends) else so_far
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out, "__part"])

    schema = df.withColumn(out, F.lit(0).cast("long")).withColumn("__part", F.lit(0)).schema
    for field in schema:
        field.nullable = True
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), label)
    sums = sorted((r["__part"], r["n"]) for r in local.groupBy("__part").agg(F.sum(size).alias("n")).collect())  # one a partition
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __before long")
    return local.join(F.broadcast(before), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


def _measure(min_words: int):
    """Per document: hashes of the lines that hold words, their numbers, and the shortest runs from and up to each."""

    def run(batches):
        for batch in batches:
            numbers, forward, backward = [], [], []
            for counts in batch.column("words"):
                words = counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.flatnonzero(words)
                cum = np.concatenate(([0], np.cumsum(words[at])))
                n = len(at)
                ends = np.searchsorted(cum, cum[:-1] + min_words, side="left")  # first end with enough words
                fwd = np.where(ends <= n, ends - np.arange(n), 0)
                starts = np.searchsorted(cum, cum[1:] - min_words, side="right") - 1  # last start with enough words
                bwd = np.where(starts >= 0, np.arange(n) - starts + 1, 0)
                numbers.append(at.astype(np.int32))
                forward.append(fwd.astype(np.int32))
                backward.append(bwd.astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), batch.column("hashes"), pa.array([len(n) + 1 for n in numbers], pa.int64()), pa.array(numbers, ints), pa.array(forward, ints), pa.array(backward, ints)],
                names=["id", "th", "hashes", "size", "numbers", "forward", "backward"],
            )

    return run


def _ranked(groups: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups (``keys``, n, more) with the rank of their first member: how many members are before them."""
    return running(groups, keys, "n", "rank", label)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, gone, stays) of each document that has lines to delete: their numbers (from 0), and for each line up to the
    last of them whether it stays; th: xxhash64 of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))
    words = F.transform("lines", lambda s: F.size(F.filter(F.split(s, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")))
    hashes = F.transform("lines", lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(1), s).alias("b")))
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, th long, hashes array<struct<a: long, b: long>>, size long, numbers array<int>, forward array<int>, backward array<int>"
    measured = written(rows.select("id", "th", hashes.alias("hashes"), words.alias("words")).mapInArrow(_measure(min_words), shape), "measured").dropDuplicates(["id", "th"])
    # null ids come last; one border after each document
    keyed = measured.withColumn("none", F.col("id").isNull().cast("int"))
    placed = running(keyed, ["none", "id", "th"], "size", "start", "placed")
    each = placed.select("start", F.posexplode(F.arrays_zip("numbers", "forward", "backward")).alias("k", "x"), "hashes").select(
        (F.col("start") + F.col("k")).alias("pos"), "start", F.element_at("hashes", F.col("x.numbers") + 1).alias("line"), F.col("x.forward").alias("forward"), F.col("x.backward").alias("backward"),
    )
    lines = written(each, "lines")
    groups = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = written(_ranked(groups.select(F.col("line.a").alias("a"), F.col("line.b").alias("b"), "n"), ["a", "b"], "names").select(F.struct("a", "b").alias("line"), "n", "rank"), "ids")
    spread = F.struct(F.col("pos").alias("a"), F.lit(0).cast("long").alias("b"))
    repeated = written(with_groups(lines, named, "line", "n", spread).filter("rank IS NOT NULL").drop("line", "n"), "repeated")

    # runs to look up: (first position, lines)
    asked = repeated.select("pos", "start", F.explode(F.array(
        F.struct(F.lit(0).alias("back"), F.col("forward").alias("length")), F.struct((F.col("backward") - 1).alias("back"), F.col("backward").alias("length")),
    )).alias("w")).filter("w.length > 0").select((F.col("pos") - F.col("w.back")).alias("first"), F.col("w.length").alias("length"), "start").distinct()
    asked = written(asked.withColumn("level", F.floor(F.log2("length")).cast("int")), "runs")
    top = asked.agg(F.max("level").alias("top")).first()["top"]
    if top is None:
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, th long, {_FOUND}")

    ranks, found = repeated.select("pos", "rank"), []
    for level in range(top + 1):
        half = 1 << level
        here = asked.filter(F.col("level") == level)
        begin = here.join(ranks.select(F.col("pos").alias("first"), F.col("rank").alias("a")), "first")
        end = begin.withColumn("pos", F.col("first") + F.col("length") - half).join(ranks.withColumnRenamed("rank", "b"), "pos")
        found.append(end.select("first", "length", "start", F.struct("length", "a", "b").alias("run")))
        if level == top:
            break
        pairs = ranks.join(ranks.select((F.col("pos") - half).alias("pos"), F.col("rank").alias("next")), "pos").select("pos", F.struct(F.col("rank").alias("a"), F.col("next").alias("b")).alias("pair"))
        pairs = written(pairs, "pairs")
        repeats = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        order = written(_ranked(repeats.select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "n"), ["a", "b"], "order").select(F.struct("a", "b").alias("pair"), "n", "rank"), "ranks")
        loose = F.struct(F.lit(-1).cast("long").alias("a"), F.col("pos").alias("b"))
        ranks = written(with_groups(pairs, order, "pair", "n", loose).filter("rank IS NOT NULL").select("pos", "rank"), f"level{level + 1}")
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    runs = written(runs, "found")
    intervals = written(runs.groupBy("run").agg(F.min("first").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "intervals")
    loose = F.struct(F.lit(-1).alias("length"), F.col("first").alias("a"), F.col("start").alias("b"))
    copies = with_groups(runs, intervals, "run", "n", loose).filter("earliest < first")
    # a document has two shortest runs a line at most, so this list is no longer than its text
    each = copies.groupBy("start").agg(F.collect_list(F.struct((F.col("first") - F.col("start")).cast("int").alias("at"), F.col("length").cast("int").alias("length"))).alias("runs"))
    held = each.join(placed.select("start", "id", "th", "numbers"), "start").select("id", "th", "numbers", F.col("runs.at").alias("at"), F.col("runs.length").alias("length"))
    return written(held.mapInArrow(_merged, f"id {docs.schema[id_col].dataType.simpleString()}, th long, {_FOUND}"), "gone")


def _merged(batches):
    """Per document: its copied runs in one, as the numbers of the lines that go and a flag a line."""
    for batch in batches:
        gone, stays = [], []
        for numbers, at, length in zip(batch.column("numbers"), batch.column("at"), batch.column("length")):
            own, first = numbers.values.to_numpy(), at.values.to_numpy()
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + length.values.to_numpy(), -1)
            gone.append(own[np.cumsum(change[:-1]) > 0])
            flags = np.ones(int(gone[-1][-1]) + 1, bool)
            flags[gone[-1]] = False
            stays.append(flags)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(gone, pa.list_(pa.int32())), pa.array(stays, pa.list_(pa.bool_()))], names=["id", "th", "gone", "stays"])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, out: str = "gone", flags: str = "stays") -> DataFrame:
    """``docs`` with the numbers of the lines to delete (null: none), and for each line up to the last of them whether it stays."""
    th, id2, th2 = (fresh([*docs.columns, out, flags], n) for n in ("th", "__id2", "__th2"))
    found = later_copies(docs, id_col, text_col, min_words).select(F.col("id").alias(id2), F.col("th").alias(th2), F.col("gone").alias(out), F.col("stays").alias(flags))
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # at every size by shuffle, so that a small run tells what a large one costs
    joined = keyed.join(found.hint("merge"), (F.col(th) == F.col(th2)) & F.col(id_col).eqNullSafe(F.col(id2)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], out, flags)


def _kept(text, stays):
    """The text without the lines whose flag is false, in one walk; lines after the last flag stay."""
    lines = F.zip_with(F.split(text, "\n", -1), stays, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    return F.array_join(F.array_compact(lines), "\n")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated line runs; columns stay as they are.

    A run shorter than ``min_words`` words stays, however often it occurs.  The first copy, in order of id (nulls last),
    then text hash, then line, stays.  A document of which nothing but blank lines is left goes as a whole; one without words from the start stays as it is, as do null and empty texts.  Rows that
    repeat an id and its text count as one document and are treated alike.  Lines are compared whole, by two 64-bit hashes.
    """
    gone, stays = fresh(docs.columns, "gone"), fresh(docs.columns, "stays")
    found = marked(docs, id_col, text_col, min_words, gone, stays)
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_kept(F.col(text_col), F.col(stays)))
    cleaned = found.withColumn(text_col, text)
    return cleaned.filter(F.col(gone).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines deleted, and the digest and length of what is left."""
    found = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    left = F.when(F.col("gone").isNull(), text).otherwise(_kept(text, F.col("stays")))
    return found.select(
        "doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("left_sha256"),
    )
