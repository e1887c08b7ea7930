"""Change streams: debouncing, self-write suppression, renames, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.mutations import upsert
from ..sources.tables import written

# The journal's reason flags that matter.
CREATED, DELETED, OVERWRITTEN, EXTENDED, TRUNCATED, RENAMED_OLD, RENAMED_NEW = 0x100, 0x200, 0x1, 0x2, 0x4, 0x1000, 0x2000
MATERIAL = CREATED | DELETED | OVERWRITTEN | EXTENDED | TRUNCATED | RENAMED_OLD | RENAMED_NEW


def source(spark: SparkSession, path: str, schema, files_at_once: int = 16) -> DataFrame:
    """Changes that land as Parquet files, read once each; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def debounced(changes: DataFrame, at: str, key: str, silence: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a key: a session closes after the silence."""
    timed = changes.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, silence).alias("burst"), key).agg(F.count(F.lit(1)).alias("changes"), F.max(at).alias("last_at")).select(key, F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "changes", "last_at")


def windowed(changes: DataFrame, at: str, key: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts: an addition for streams with late data."""
    timed = changes.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("changes")).select(key, F.col("w.start").alias("started"), "changes")


def foreign(changes: DataFrame, announced: DataFrame, running: DataFrame, path: str, at: str, expiry: str = "5 minutes", ahead: str | None = None) -> DataFrame:
    """Changes that this system did not make itself: no announcement of the path that is fresh or whose writer still runs.

    ``ahead``: how long before its announcement a change may be (unset: any time).  ``state.foreign`` is the form for streams.
    """
    live = announced.join(running.select(F.col("execution_id").alias("__e"), F.lit(True).alias("__runs")), F.col("execution_id") == F.col("__e"), "left")
    own = live.select(F.col("path").alias("__p"), F.col("announced_at").alias("__a"), F.coalesce("__runs", F.lit(False)).alias("__live"))
    fresh = F.col("__a") + F.expr(f"INTERVAL {expiry}") >= F.col(at)
    if ahead:
        fresh = fresh & (F.col("__a") - F.expr(f"INTERVAL {ahead}") <= F.col(at))
    return changes.join(own, (F.col(path) == F.col("__p")) & (F.col("__live") | fresh), "left_anti")


def needs_full_pass(reason: Column) -> Column:
    return reason.isin("EVENTS_LOST", "UNREPLAYABLE", "INCOMPLETE")


def interpreted(journal: DataFrame, root: str) -> DataFrame:
    """(path, action) out of a journal batch: seq, file_ref, path, reason_flags, directory.

    Old and new names of a rename pair by file, in order, whatever else happens to the file between them; a move out of the
    root reports the old path, a move into it the new one, within it both; an old name without a new one is reported as
    gone.  A directory's rename asks for a full reconciliation if either name is below the root, its creation and deletion
    for nothing.  ``state.interpreted`` is the form for streams, where the halves of a rename may be batches apart.
    """
    has = lambda flag: F.col("reason_flags").bitwiseAND(F.lit(flag)) != 0
    below = lambda c: F.coalesce(F.lower(c).startswith(root.lower().rstrip("/\\") + "/"), F.lit(False))
    old, moved = has(RENAMED_OLD), has(RENAMED_OLD | RENAMED_NEW)
    rows = journal.withColumn("directory", F.coalesce("directory", F.lit(False)))
    order = Window.partitionBy("file_ref").orderBy("seq")
    # a pair is an old name and the new one that is the next half of a rename
    halves = rows.filter(moved).withColumn("old_path", F.when(F.lag(old).over(order) & ~old, F.lag("path").over(order))).withColumn("old_directory", F.coalesce(F.lag("directory").over(order) & F.lag(old).over(order) & ~old, F.lit(False)))
    single = rows.filter(has(MATERIAL) & ~moved & ~F.col("directory") & below(F.col("path"))).select("path", F.lit("CHECK").alias("action"))
    halves = halves.withColumn("new_directory", F.coalesce(F.lead("directory").over(order) & ~F.lead(old).over(order) & old, F.lit(False)))
    folder = F.col("directory") | F.col("old_directory") | F.col("new_directory")
    whole = halves.filter(folder & (below(F.col("path")) | below(F.col("old_path")))).select(F.lit(root).alias("path"), F.lit("RECONCILE").alias("action"))
    # of files each half reports its own path
    named = halves.filter(~folder & below(F.col("path"))).select("path", F.lit("CHECK").alias("action"))
    return single.unionByName(whole).unionByName(named).distinct()


def backlog(changes: DataFrame, cursors: DataFrame, key: str, seq: str) -> DataFrame:
    """The changes of each source (``key``) that came after its cursor; a source without one has all of them."""
    known = cursors.select(F.col(key).alias("__key"), F.col("cursor").alias("__cursor"))
    return changes.join(known, F.col(key) == F.col("__key"), "left").filter(F.col("__cursor").isNull() | (F.col(seq) > F.col("__cursor"))).drop("__key", "__cursor")


def advanced(cursors: DataFrame, walks: DataFrame, key: str) -> DataFrame:
    """(key, cursor) after some walks (key, captured, complete): the highest position captured before a complete walk.

    An incomplete walk leaves its source's cursor as it is, and no cursor goes back.
    """
    done = walks.filter("complete").groupBy(key).agg(F.max("captured").alias("captured"))
    both = cursors.join(done, key, "full_outer")
    return both.select(key, F.greatest("cursor", "captured").alias("cursor"))


def due(runs: DataFrame, root: str, started: str, finished: str, now: Column, every: str = "5 minutes") -> DataFrame:
    """(root, last): roots whose timer is up: no run is under way and the last one began so long ago."""
    each = runs.groupBy(root).agg(F.max(started).alias("last"), F.bool_or(F.col(finished).isNull()).alias("__runs"))
    return each.filter(~F.col("__runs") & (F.col("last") + F.expr(f"INTERVAL {every}") <= now)).select(root, "last")


def on_timer(ticks: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes"):
    """A started query that calls ``work`` on what a stream brought, every so often (a full reconciliation, say)."""
    return ticks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


BUCKETS = 256


def upsert_into(folder: str, keys: list[str], newest: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: at-least-once batches merged into a table of buckets by a hash of the key.

    A batch rewrites only the buckets that it touches, each of which Spark replaces as a whole, and old versions don't pile
    up; a repeated batch changes nothing.  ``read_upserted`` reads the table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            touched = [r["__bucket"] for r in rows.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
            old = spark.read.schema(rows.schema).parquet(folder).filter(F.col("__bucket").isin(touched))
        else:
            old = rows.limit(0)
        merged = written(upsert(old.select(*rows.columns), upsert(rows.limit(0), rows, keys, newest), keys, newest), "merged")
        merged.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(folder)

    return run


def read_upserted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("__bucket")
