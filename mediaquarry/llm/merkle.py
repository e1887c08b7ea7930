r"""Merkle manifests of a data set: leaves in blocks of a fixed size, collapsed by higher-order functions.

A leaf is the SHA-256 of a row's fields.  Leaves are numbered in their group (a language, say) by id; ``FANOUT ** LEVELS``
consecutive ones are gathered into one ordered array, and LEVELS levels of the tree come out of that array alone: ``sequence``
and ``slice`` cut it into runs, ``transform`` hashes them, ``aggregate`` goes on to the next level.  A block's root is a node of
the next tier, and tiers are built until every group is one block; then the groups' roots are the leaves of one more tree.
On the way down each block hands its members their siblings, so that a proof is put together from one array a tier.

No task holds more than a block; a tier has 1/512 of the rows of the one below, and the tiers (four for 10**11 rows) are
written tables.  A text passes only the scan: all that is shuffled are digests and ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutations import with_ids
from .common import crc32_of, fresh, table, with_groups, written

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values: ``-`` for null, else the UTF-8 length, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def _group_key(group: Column) -> Column:
    """A text that sorts as the group does, bytewise, null first; never null."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def _depth(n: Column) -> Column:
    """How many levels a block of a group of n nodes collapses."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _levels(digests: Column, depth: Column) -> Column:
    """The block's levels from below, each an array of digests; the last one is its root."""
    runs = lambda nodes: F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    collapsed = lambda nodes: F.transform(runs(nodes), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))
    return F.aggregate(_upto(depth), F.array(digests), lambda so_far, _: F.concat(so_far, F.array(collapsed(F.element_at(so_far, -1)))))


def _upto(depth: Column) -> Column:
    """0, 1, ... before ``depth``."""
    return F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), depth)


def _siblings(levels: Column, place: Column, depth: Column) -> Column:
    """What stands left and right of the node on the way from a block's member to the block's root."""

    def beside(level: Column) -> Column:
        nodes = F.element_at(levels, level + 1)
        at = F.floor(place / F.pow(F.lit(FANOUT), level)).cast("int")
        k = F.pmod(at, F.lit(FANOUT))
        text = lambda start, count: F.array_join(F.slice(nodes, start, count), "")
        return F.struct(text(at - k + 1, k).alias("left"), text(at + 2, FANOUT - 1 - k).alias("right"))

    return F.transform(_upto(depth), beside)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over nodes (g, pos, n, digest, and what else a member carries), and each group's (g, digest).

    ``n``: the group's number of nodes.
    """
    tiers = []
    while True:
        member = F.struct("pos", "digest", *[c for c in nodes.columns if c not in ("g", "pos", "n", "digest")])
        blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("b")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
        levels = _levels(F.transform("members", lambda m: m["digest"]), _depth(F.col("n")))
        tiers.append(written(blocks.withColumn("root", F.element_at(F.element_at(levels, -1), 1)), "tier"))
        nodes = tiers[-1].select("g", F.col("b").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
        if (tiers[-1].agg(F.max("n").alias("n")).first()["n"] or 0) <= BLOCK:
            return tiers, nodes.select("g", "digest")


def _descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The members of the lowest tier with their ``path``, from themselves to where the path of ``tops`` (g, path, more) ends."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("b", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        depth, levels = _depth(F.col("n")), F.col("levels")
        joined = blocks.drop("root").join(above, ["g", "b"]).withColumn("levels", _levels(F.transform("members", lambda m: m["digest"]), _depth(F.col("n"))))
        each = F.transform("members", lambda m, j: F.struct(m.alias("m"), F.concat(_siblings(levels, j, depth), F.col("path")).alias("path")))
        members = joined.select("g", *more, F.inline(each))
        above = members.select("g", F.col("m.pos").alias("b"), "path", *more)
    return members.select("g", "m.*", "path", *more)


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (g, digest, more) with ``pos`` in their group and the group's ``n``."""
    numbered = with_ids(leaves, [F.col(c) for c in ["g", *order, "digest", "salt"]], out="__place")
    groups = written(numbered.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("__first")), "groups")
    placed = with_groups(numbered, groups, "g", "n", F.concat("g", F.lit("\0"), F.col("__place").cast("string")))
    return placed.withColumn("pos", F.col("__place") - F.col("__first")).drop("__place", "__first", "salt")


def prove(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group: Column | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """(id, ``also``, leaf, group_key, position, path, subroot, root) of every row: its place in the manifest and its proof.

    Leaves ascend by id in their group (null first, equal ids by leaf, so that repeated rows are leaves of their own and in any
    order the same).  Null groups are a group, the first.  No groups at all: one tree, whose subroot is the root.  An empty
    table has no rows and no root.  Columns that ``leaf``, ``group`` and ``also`` don't name are not read.
    """
    own = [fresh([id_col], f"__own{k}") for k in range(len(also))]
    key = fresh(own, "__id")
    spread = F.xxhash64(F.monotonically_increasing_id())  # equal rows may go to different tasks, where their order is of no account
    leaves = written(docs.select(_group_key(group if group is not None else F.lit(None)).alias("g"), F.col(f"`{id_col}`").alias(key), *[c.alias(n) for c, n in zip(also, own)], leaf.alias("digest"), spread.alias("salt")), "leaves")
    tiers, subroots = _climb(_numbered(leaves, [key]))
    subroots = written(subroots, "subroots")
    total = subroots.count()
    tops = with_ids(subroots, [F.col("g")], out="pos").select(F.lit("").alias("g"), "pos", F.lit(total).cast("long").alias("n"), "digest", F.col("g").alias("member"))
    top_tiers, root = _climb(tops)
    start = root.select("g", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    roots = _descend(top_tiers, start).select(F.col("member").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    found = _descend(tiers, written(roots, "roots"))
    names = [c for c in docs.select(*also).columns] if also else []
    return found.select(F.col(key).alias(id_col), *[F.col(o).alias(n) for o, n in zip(own, names)], F.col("digest").alias("leaf"), F.col("g").alias("group_key"), F.col("pos").alias("position"), "path", "subroot", "root")


def write_manifest(docs: DataFrame, path: str, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str | None = "lang") -> str | None:
    """Writes the manifest (Parquet: id, leaf, group_key, position, proof path, subroot, root) and returns its root."""
    made = prove(docs, leaf_of(*[F.col(f"`{c}`") for c in fields]), id_col, F.col(f"`{group_col}`") if group_col else None)
    made.write.parquet(path)
    first = docs.sparkSession.read.parquet(path).select("root").first()
    return first["root"] if first else None


def audit(docs: DataFrame, manifest: DataFrame, root: str, fields: Sequence[str] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """(id, status) of whatever is not as the manifest with the trusted ``root`` says: changed, missing, added, or forged.

    Forged: the manifest's own leaf doesn't fold to the root.  A row is known by its id and leaf, so that of repeated ids only
    those that differ are named; as many rows of one leaf must be there as in the manifest.
    """
    now = docs.select(F.col(f"`{id_col}`").alias("id"), leaf_of(*[F.col(f"`{c}`") for c in fields]).alias("leaf")).groupBy("id", "leaf").agg(F.count(F.lit(1)).alias("here"))
    then = manifest.groupBy(F.col(f"`{id_col}`").alias("id"), "leaf").agg(F.count(F.lit(1)).alias("there"), F.bool_and(folded(F.col("leaf"), F.col("path")) == root).alias("sound"))
    both = now.join(then, now["id"].eqNullSafe(then["id"]) & (now["leaf"] == then["leaf"]), "full_outer")
    each = both.select(F.coalesce(now["id"], then["id"]).alias(id_col), (F.coalesce("here", F.lit(0)) - F.coalesce("there", F.lit(0))).alias("more"), F.coalesce("sound", F.lit(True)).alias("sound"))
    told = each.groupBy(id_col).agg(F.max("more").alias("most"), F.min("more").alias("least"), F.bool_and("sound").alias("sound"))
    status = F.when(~F.col("sound"), "forged").when((F.col("most") > 0) & (F.col("least") < 0), "changed").when(F.col("most") > 0, "added").when(F.col("least") < 0, "missing")
    return told.select(id_col, status.alias("status")).filter("status IS NOT NULL")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all ``documents``, each proof tried on a text that is tampered with where 3 divides the CRC-32
    of its id; nulls are leaves like others, and a tampered text without A-Z verifies."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    altered = leaf_of(*fields[:-1], F.translate("text", _UPPER, _LOWER))
    told = F.when(F.pmod(crc32_of("doc_id"), F.lit(3)) == 0, altered)
    found = prove(docs, leaf_of(*fields), "doc_id", F.col("lang"), [told.alias("told")])
    result = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("told", "leaf"), F.col("path")).alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))), "
    "lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS told FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (SELECT g, 0 AS level, p, n, leaf AS digest FROM placed
  UNION ALL SELECT g, level + 1, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY g, level, p // 8, n),
subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, p, n, subroot AS digest FROM subs
  UNION ALL SELECT level + 1, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY level, p // 8, n),
runs AS (SELECT g, level, p // 8 AS r, list(digest ORDER BY p) AS ds FROM nodes WHERE n > 1 GROUP BY g, level, p // 8),
top_runs AS (SELECT level, p // 8 AS r, list(digest ORDER BY p) AS ds FROM tops WHERE n > 1 GROUP BY level, p // 8),
walk AS (SELECT g, p AS place, n, 0 AS level, p, coalesce(told, leaf) AS node, '' AS proof FROM placed
  UNION ALL SELECT w.g, w.place, (w.n + 7) // 8, w.level + 1, w.p // 8,
    sha256(array_to_string(ds[1:w.p % 8], '') || node || array_to_string(ds[w.p % 8 + 2:], '')), proof || array_to_string(ds[1:w.p % 8], '') || array_to_string(ds[w.p % 8 + 2:], '')
  FROM walk w JOIN runs r ON r.g = w.g AND r.level = w.level AND r.r = w.p // 8),
walk2 AS (SELECT w.g, w.place, s.n, 0 AS level, s.p, node, proof FROM walk w JOIN subs s ON s.g = w.g WHERE w.n = 1
  UNION ALL SELECT w.g, w.place, (w.n + 7) // 8, w.level + 1, w.p // 8,
    sha256(array_to_string(ds[1:w.p % 8], '') || node || array_to_string(ds[w.p % 8 + 2:], '')), proof || array_to_string(ds[1:w.p % 8], '') || array_to_string(ds[w.p % 8 + 2:], '')
  FROM walk2 w JOIN top_runs r ON r.level = w.level AND r.r = w.p // 8)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.digest AS verified
FROM placed l JOIN subs s ON s.g = l.g JOIN walk2 w ON w.g = l.g AND w.place = l.p AND w.n = 1 CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
