"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into eight segments of eight bits on a ring.  If two fingerprints differ in at most
``budget`` bits, then by the pigeonring principle some start has a chain in which the first l segments together differ in
at most l * budget / 8 bits, for every l.  For a budget of 3 the chain's first two segments are equal and of the next three
at most one differs, so both fingerprints share one of 24 keys of four whole segments.  For a budget of 7 the first segment
is equal and the next two differ in at most two bits, so both share one of 48 keys of that segment and two of the next four
half segments.  Those keys, made of distinct fingerprints, deal the candidates; the whole chain is checked before the full
Hamming distance.

Copies never meet: equal fingerprints are one row.  Inside a key's run a search links each fingerprint once, so a run of
n gives at most n - 1 links (a spanning forest of the real ones), never all pairs.  Keys that hold more than ``run_rows``
fingerprints are split into a grid of salted cells, whose tasks are bounded.  Components come from minimum labels with
pointer jumping over written tables.

Where more than the closest fingerprints is asked for, texts meet by their MinHash sketches: of 24 values 14 agree, so that
at most ten of their twelve pairs of values differ and two pairs at least are the same.  Each pair of values is a key, and
no two such sketches miss each other.  Their links are confirmed inside the run, by the Hamming distance or by the share
of common shingles, before the search follows them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, with_groups, written

SEGMENTS, SEGMENT_BITS, BUDGET = 8, 8, 3
SHINGLE = 3
SKETCH, AGREE = 24, 14  # MinHash values, and how many must agree where links are held against the texts
SHARED = (4, 5)  # the share of common shingles, 0.8, from which texts whose fingerprints are further apart are near copies
_ODD = np.array([2 * xxhash.xxh64_intdigest(b"sketch %d" % k) + 1 & (1 << 64) - 1 for k in range(SKETCH)], dtype=np.uint64)
_BELOW = np.array([1 << b for b in range(64)], dtype=np.uint64)


def _shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> list[int]:
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops)]


def _fingerprint(hashes: list[int]) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BELOW[votes * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The SimHash of a whole text's word shingles (lower-cased A-Z, repeats included); zero without words."""
    return _fingerprint(_shingle_hashes(text, shingle, seed))


def _sketch(hashes: list[int]) -> bytes:
    """MinHash values of the shingles; their agreement estimates how many shingles two texts share."""
    grid = np.array(hashes or [0], np.uint64)
    return b"".join(int((grid * m >> np.uint64(32)).min()).to_bytes(4, "little") for m in _ODD)


def _shingle_set(hashes: list[int]) -> bytes:
    """The distinct shingles as 32-bit numbers."""
    return np.unique(np.array(hashes or [0], np.uint64) >> np.uint64(32)).astype("<u4").tobytes()


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE, sketch: str | None = None) -> DataFrame:
    """``docs`` with the fingerprint as a signed long, and with a sketch if its column is named."""

    def run(batches):
        for batch in batches:
            hashes = (_shingle_hashes(t.as_py(), shingle) for t in batch.column(text_col))
            pairs = [(_fingerprint(h), _sketch(h) if sketch else None) for h in hashes]
            found = batch.append_column(out, pa.array(np.array([f for f, _ in pairs], dtype=np.uint64).view(np.int64)))
            yield found.append_column(sketch, pa.array([k for _, k in pairs], pa.binary())) if sketch else found

    added = docs.withColumn(out, F.lit(None).cast("long"))
    return docs.mapInArrow(run, (added.withColumn(sketch, F.lit(None).cast("binary")) if sketch else added).schema)


def _with_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, sketch, shingles) of (fp, sketch, text)."""

    def run(batches):
        for batch in batches:
            sets = [_shingle_set(_shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("sketch"), pa.array(sets, pa.binary())], names=["fp", "sketch", "shingles"])

    return texts.mapInArrow(run, "fp long, sketch binary, shingles binary")


def key_families(budget: int = BUDGET) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(start, ((first bit, bits), ...)): what two fingerprints within the budget share for one family at least.

    Up to 3: two segments in a row, and two of the next three.  Up to 7: one segment, and two of the next four halves.
    """
    if not 0 <= budget <= 7:
        raise ValueError("the keys hold for budgets of 0 to 7 bits")
    whole = lambda s: (8 * (s % 8), 8)
    if budget <= 3:
        return [(s, (whole(s), whole(s + 1), *(whole(s + 2 + i) for i in pair))) for s in range(SEGMENTS) for pair in combinations(range(3), 2)]
    half = lambda s, k: (8 * ((s + 1 + k // 2) % 8) + 4 * (k % 2), 4)
    return [(s, (whole(s), *(half(s, k) for k in pair))) for s in range(SEGMENTS) for pair in combinations(range(4), 2)]


def _keys(fp, budget: int) -> F.Column:
    """A family's number above the bits that it takes."""
    out = []
    for number, (_, pieces) in enumerate(key_families(budget)):
        key = F.lit(number).cast("long")
        for first, bits in pieces:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        out.append(key)
    return F.array(*out)


def _ring_masks(start: int, budget: int) -> list[tuple[np.uint64, int]]:
    """Masks of the chain's first 1, 2, ... 8 segments with their budgets."""
    out, mask = [], 0
    for length in range(1, SEGMENTS + 1):
        mask |= 255 << (8 * ((start + length - 1) % SEGMENTS))
        out.append((np.uint64(mask), length * budget // SEGMENTS))
    return out


_RINGS = {(s, b): _ring_masks(s, b) for s in range(SEGMENTS) for b in range(8)}


def linked(one: np.uint64, others: np.ndarray, start: int, budget: int = BUDGET) -> np.ndarray:
    """Indices of ``others`` within the budget whose chain from ``start`` holds; each step looks at what the last left."""
    left = np.arange(len(others))
    differ = others ^ one
    for mask, most in _RINGS[start, budget][:-1]:
        left = left[np.bitwise_count(differ[left] & mask) <= most]
        if not len(left):
            return left
    return left[np.bitwise_count(differ[left]) <= budget]


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among a run's rows; ``near`` gives the places in the second that the first links to."""
    edges = []
    waiting = np.arange(n)
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            u = queue.pop()
            places = near(u, waiting)
            if len(places):
                found = waiting[places]
                edges += [(u, int(v)) for v in found]
                queue += found.tolist()
                waiting = np.delete(waiting, places)
    return edges


def _alike(fps: np.ndarray, sketches: np.ndarray, sets: np.ndarray | None, budget: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links by sketches; with shingle sets only those within the budget or with enough shingles in common."""
    numbered: list[np.ndarray] = []

    def common(u: int, others: np.ndarray) -> np.ndarray:
        if not numbered:  # the run's shingles as small numbers
            _, own = np.unique(np.concatenate(sets), return_inverse=True)
            numbered.extend(np.split(own.astype(np.int32), np.cumsum([len(x) for x in sets])[:-1]))
            numbered.append(np.zeros(int(own.max()) + 1, bool))
        marks = numbered[-1]
        marks[numbered[u]] = True
        sizes = np.array([len(sets[v]) for v in others])
        both = np.add.reduceat(marks[np.concatenate([numbered[v] for v in others])], np.cumsum(sizes) - sizes, dtype=np.int64)
        marks[numbered[u]] = False
        return both * SHARED[1] >= (len(sets[u]) + sizes - both) * SHARED[0]

    def near(u: int, waiting: np.ndarray) -> np.ndarray:
        places = np.flatnonzero((sketches[waiting] == sketches[u]).sum(1) >= AGREE)
        if sets is None or not len(places):
            return places
        others = waiting[places]
        held = np.bitwise_count(fps[others] ^ fps[u]) <= budget
        far = np.flatnonzero(~held)
        if len(far):
            held[far] = common(u, others[far])
        return places[held]

    return near


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Key, cell, fingerprint and, if they are there, sketch and shingle set."""
    out = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "cell", "fp")]
    if "sketch" in batch.schema.names:
        out.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH))
    if "shingles" in batch.schema.names:
        sets = np.empty(len(batch), object)
        sets[:] = [np.frombuffer(x, "<u4") for x in batch.column("shingles").to_pylist()]
        out.append(sets)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The key of each run of a sorted partition with its fingerprints (and more); a run may cross batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(_arrays(batch))
        key, cell = held[-1][0], held[-1][1]
        if (key[-1], cell[-1]) == (held[0][0][0], held[0][1][0]):
            continue  # all of one run so far
        rows = [np.concatenate(c) for c in zip(*held)]
        key, cell = rows[0], rows[1]
        edge = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = np.concatenate(([0], edge))
        sizes = np.diff(bounds)
        for a, n in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            yield int(key[a]), [c[a : a + n] for c in rows[2:]]
        held = [[c[bounds[-1] :] for c in rows]]
    if sum(len(h[0]) for h in held) > 1:
        rows = [np.concatenate(c) for c in zip(*held)]
        yield int(rows[0][0]), rows[2:]


def _link_runs(budget: int, alike: bool = False):
    families = key_families(budget)
    width = sum(bits for _, bits in families[0][1])

    def run(batches):
        ours: list[np.ndarray] = []
        for key, (signed, *more) in _runs(batches):
            signed = np.ascontiguousarray(signed)
            fps = signed.view(np.uint64)
            if alike:
                near = _alike(fps, more[0], more[1] if len(more) > 1 else None, budget)
            else:
                start = families[key >> width][0]
                near = lambda u, waiting: linked(fps[u], fps[waiting], start, budget)  # noqa: B023, E731  used up before the next run
            found = forest(len(fps), near)
            if found:
                pair = np.array(found)
                ours.append(np.stack([signed[pair[:, 0]], signed[pair[:, 1]]], axis=1))
            if sum(map(len, ours)) > 1 << 16:
                yield _links(ours)
                ours = []
        if ours:
            yield _links(ours)

    return run


def _links(parts: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(parts)
    return pa.RecordBatch.from_arrays([pa.array(rows.min(1)), pa.array(rows.max(1))], names=["a", "b"])


def links(fps: DataFrame, run_rows: int = 4096, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``, distinct) that keep every component whole."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), budget)).alias("key"))
    return _dealt(keyed, run_rows, fps.count() * len(key_families(budget))).mapInArrow(_link_runs(budget), "a long, b long").distinct()


def alike_links(nodes: DataFrame, run_rows: int = 4096, budget: int = 7) -> DataFrame:
    """(a, b): links between ``nodes`` (fp, distinct, and sketch) whose sketches agree, that keep every component whole.

    With the column ``shingles`` only pairs within the budget, or that share enough of their shingles, are linked.
    """
    pairs = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + 8 * k, 8)) for k in range(SKETCH // 2)])
    keyed = nodes.select("*", F.explode(pairs).alias("key"))
    return _dealt(keyed, run_rows, nodes.count() * (SKETCH // 2)).mapInArrow(_link_runs(budget, alike=True), "a long, b long").distinct()


def _dealt(keyed: DataFrame, run_rows: int, rows: int) -> DataFrame:
    """Rows with a key, sorted into runs of a key and cell; the keys of many rows are split into cells."""
    more = [c for c in keyed.columns if c != "key"]
    counted = keyed.groupBy("key").count()
    hot = written(counted.filter(F.col("count") > run_rows), "hot")
    # only keys above a 4096th of all rows are sure to be few
    cells = F.ceil(F.col("count") / F.lit(run_rows // 2)).cast("int")
    few = hot.filter(F.col("count") > rows / 4096).select("key", cells.alias("n"))
    rest = hot.filter(F.col("count") <= rows / 4096).select("key", cells.alias("n"))
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("cell"), *more)
    else:
        known = F.broadcast(few)  # fewer than 4096 keys
        marked = keyed.join(known, "key", "left").withColumnRenamed("n", "few").join(rest, "key", "left")
        n = F.coalesce("few", "n", F.lit(1))
        mine = F.pmod(F.xxhash64("fp"), n).cast("int")
        # cell (i, j) with i <= j sees the rows of both salts, so each pair of rows meets
        where = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.least(k, F.col("mine")) * F.col("n_all") + F.greatest(k, F.col("mine"))).cast("int"))
        dealt = marked.withColumn("n_all", n).withColumn("mine", mine).select("key", F.explode(where).alias("cell"), *more)
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, root): each node with the smallest node that it reaches; minimum labels and pointer jumping."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    ends = both.select(F.col("u").alias("node")).distinct()
    labels = written(ends.select("node", F.col("node").alias("root")), "labels")
    while True:
        offered = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), F.col("root"))
        least = offered.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        nearer = written(least, "nearer")
        jump = nearer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = written(nearer.join(jump, "root").select("node", F.col("next").alias("root")), "labels")
        changed = after.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        labels = after
        if not changed:
            break
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp``, ``component_id`` (the smallest id that links reach).

    Null and empty texts have fingerprint zero and link like any other.  Null ids take part and are never the smallest,
    unless a component has no other (then null).  Repeated ids stay repeated.  An empty table gives an empty result.
    """
    rows = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle).select("doc_id", "fp"), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    edges = written(links(nodes.select("fp")), "links")
    rooted = written(components(edges, nodes.select("fp")).join(nodes, "fp"), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = written(rooted.join(lows, "root").select("fp", "component_id", "n"), "members")
    # copies and empty texts may be a third of all rows with one fingerprint
    return with_groups(rows, whole, "fp", "n", F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 7) -> DataFrame:
    """The first document (smallest id) of each near-duplicate group, with all its columns; repeated rows of it once.

    With a budget above 3 bits texts are linked too if their sketches agree (see above) and either the fingerprints are
    within the budget or the texts share 0.8 of their shingles, however far apart the fingerprints are.  Chance neighbours
    in a large corpus stay apart.
    """
    number, sketch, row = (fresh(docs.columns, n) for n in ("fp", "sketch", "row"))
    found = fingerprints(docs, text_col, number, shingle, sketch if budget > 3 else None)
    marked = written(found.withColumn(row, F.monotonically_increasing_id()), "marked")  # a row's number is fixed once written
    value = F.col(sketch) if budget > 3 else F.lit(None).cast("binary")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("low"), F.col(row).alias("row"), value.alias("sketch"))).alias("best")
    nodes = written(marked.groupBy(F.col(number).alias("fp")).agg(best).select("fp", "best.low", "best.row", "best.sketch"), "nodes")
    edges = written(links(nodes.select("fp"), budget=min(budget, BUDGET)), "links")
    if budget > BUDGET:
        # only texts whose sketch agrees with another's need their shingles
        some = written(alike_links(nodes.select("fp", "sketch"), budget=budget), "alike")
        ends = written(some.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "row", "sketch"), "fp"), "ends")
        texts = marked.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")).join(ends, "row").select("fp", "sketch", "text")
        edges = edges.union(alike_links(written(_with_shingles(texts, shingle), "shingles"), 2048, budget))
    rooted = components(edges, nodes.select("fp")).join(nodes.select("fp", "low", "row"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "row")).alias("best"))
    # rows, not ids, are chosen: each once, however often its id is repeated
    kept = marked.join(first.select(F.col("best.row").alias(row)).hint("merge"), row, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; texts without words have fingerprint zero, which links like any other."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
