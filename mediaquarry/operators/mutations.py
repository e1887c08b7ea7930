"""Catalogue changes as functions from the old table to the new one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Both tables' rows, of each key the one with the largest ``newest``; of equal ones a new row, then by a hash of all its values."""
    both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    values = F.xxhash64(*[c for c, kind in old.dtypes if "map<" not in kind])
    order = [*[F.desc_nulls_last(c) for c in newest], F.desc("__new"), values]
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k", "__new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys only; of repeated new ones, one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the new table's keys are replaced as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def set_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns changed where the condition is true."""
    sure = F.coalesce(condition, F.lit(False))
    return rows.select(*[F.when(sure, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition is true; unknown is kept."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def mark_missing(files: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Active files among ``gone`` (id) become missing."""
    joined = files.join(gone.select(F.col("id").alias("__gone")).distinct(), F.col("id") == F.col("__gone"), "left")
    hit = F.col("__gone").isNotNull() & (F.col("lifecycle_status") == "ACTIVE")
    return set_where(joined, hit, lifecycle_status=F.lit("MISSING"), lifecycle_changed_at=now).drop("__gone")


def retained(files: DataFrame, cutoff: Column) -> DataFrame:
    """Without files missing since before the cutoff; without a known time they stay."""
    return delete_where(files, (F.col("lifecycle_status") == "MISSING") & (F.col("lifecycle_changed_at") < cutoff))


def inventory(files: DataFrame, seen: DataFrame, key: str = "public_id") -> DataFrame:
    """What an inventory run does to each seen key: EXTRACT (unknown), CACHED (active) or REACTIVATE."""
    known = files.select(F.col(key).alias("__key"), F.col("lifecycle_status").alias("__status"))
    joined = seen.join(known, seen[key] == F.col("__key"), "left")
    return joined.withColumn("action", F.when(F.col("__key").isNull(), "EXTRACT").when(F.col("__status") == "ACTIVE", "CACHED").otherwise("REACTIVATE")).drop("__key", "__status")


def inventory_upsert(files: DataFrame, seen: DataFrame, extracted: DataFrame, now: Column, key: str = "public_id") -> DataFrame:
    """The catalogue after an inventory run over the keys ``seen``: unknown and inactive ones take their row of ``extracted``, are
    active and changed ``now``; active ones are cache hits and stay as they are, and so does what was not seen.

    An inactive row keeps its id.  A key to extract of which there is no extracted row is left as it was.
    """
    todo = inventory(files, seen, key).filter("action <> 'CACHED'").select(key, "action").dropDuplicates([key])
    new = extracted.dropDuplicates([key]).join(todo, key)
    fresh = new.withColumn("lifecycle_status", F.lit("ACTIVE")).withColumn("lifecycle_changed_at", now)
    ids = files.select(key, F.col("id").alias("__id"))
    rows = fresh.join(ids, key, "left").withColumn("id", F.coalesce("__id", "id")).select(*files.columns)
    return files.join(rows.select(key), key, "left_anti").select(*files.columns).unionByName(rows)


def undo(movements: DataFrame, present: DataFrame) -> DataFrame:
    """(id, status, reason): what taking movements (id, source, target, status) back comes to, the latest first.

    A movement that is undone already is SKIPPED.  The target must be there and known (else ERROR, SOURCE_NOT_FOUND) and the source must
    be free (else ERROR, TARGET_EXISTS); what is UNDONE moves the file, which later decisions on the same paths see.
    ``present`` (path) is what is on disk before.  A round decides every movement that is the latest undecided one on both its
    paths, so there are as many rounds as the longest chain of moves has links.
    """
    open_ = movements.filter("status IS NULL OR status <> 'UNDONE'")
    whole = "source IS NOT NULL AND target IS NOT NULL"
    todo = written(open_.filter(whole).select("id", "source", "target"), "undo")
    state = written(present.select("path").distinct(), "present")
    done = movements.filter("status = 'UNDONE'").select("id", F.lit("SKIPPED").alias("status"), F.lit(None).cast("string").alias("reason"))
    done = done.union(open_.filter(f"NOT ({whole})").select("id", F.lit("ERROR"), F.lit("SOURCE_NOT_FOUND")))
    while not todo.isEmpty():
        latest = todo.select("id", F.explode(F.array("source", "target")).alias("path")).groupBy("path").agg(F.max("id").alias("last"))
        on = lambda side: latest.select(F.col("path").alias(side), F.col("last").alias(f"last_{side}"))
        there = lambda side: state.select(F.col("path").alias(side), F.lit(True).alias(f"has_{side}"))
        ready = todo.join(on("source"), "source").join(on("target"), "target").filter("last_source = id AND last_target = id")
        reason = F.when(F.col("has_target").isNull(), "SOURCE_NOT_FOUND").when(F.col("has_source").isNotNull(), "TARGET_EXISTS")
        decided = written(ready.join(there("source"), "source", "left").join(there("target"), "target", "left").select("id", "source", "target", reason.alias("reason")), "undone")
        moved = decided.filter("reason IS NULL")
        state = written(state.join(moved.select(F.col("target").alias("path")), "path", "left_anti").union(moved.select("source")), "present")
        done = done.union(decided.select("id", F.when(F.col("reason").isNull(), "UNDONE").otherwise("ERROR"), "reason"))
        todo = written(todo.join(decided.select("id"), "id", "left_anti"), "undo")
    return done


def beyond_latest(rows: DataFrame, keep: int, order: list[str]) -> DataFrame:
    """All but the latest ``keep`` rows: those before the last one that stays (an ordinary top-k, then a comparison)."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(keep).agg(F.min(F.struct(*order)).alias("__last"), F.count(F.lit(1)).alias("__n"))
    full = F.broadcast(last)
    return rows.crossJoin(full).filter((F.col("__n") == keep) & (F.struct(*order) < F.col("__last"))).drop("__last", "__n")


def older_than(rows: DataFrame, column: str, cutoff: Column, finished: Column) -> DataFrame:
    """Finished rows from before the cutoff."""
    return rows.filter(finished & (F.col(column) < cutoff))


def abandoned(versions: DataFrame, building: Column, started: str, now: Column, hours: int = 24) -> DataFrame:
    """Versions still in the making that began more than so many hours ago."""
    return versions.filter(building & (F.col(started) < now - F.make_dt_interval(F.lit(0), F.lit(hours))))


def current_version(history: DataFrame, rank: str, version: str, succeeded: str) -> DataFrame:
    """The version of the last migration that succeeded."""
    return history.filter(F.col(succeeded)).agg(F.max_by(version, rank).alias("version"))


def running(rows: DataFrame, size: str, out: str, label: str) -> tuple[DataFrame, int]:
    """Adds the sum of ``size`` over all rows before each row, in the order in which they lie; and the sum over all.

    Partitions sum up their own rows in a written table; their sums (one small row each) say where each begins.  No task
    sees all rows.
    """

    def run(batches):
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)) + so_far
            before = np.concatenate(([so_far], ends[:-1])) if len(ends) else ends
            so_far = int(ends[-1]) if len(ends) else so_far
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(batch), part, np.int32))], names=[*batch.schema.names, out, "__part"])

    schema = rows.withColumn(out, F.lit(0).cast("long")).withColumn("__part", F.lit(0)).schema
    local = written(rows.mapInArrow(run, schema), label)
    offsets, total = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in local.groupBy("__part").agg(F.sum(size).alias("n")).collect()):
        offsets.append((part, total))
        total += int(n)
    before = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __before long")
    return local.join(F.broadcast(before), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before"), total


def with_ids(rows: DataFrame, order: list[Column], start: int = 0, out: str = "id") -> DataFrame:
    """Deterministic consecutive ids in the given order: places in sorted range partitions."""
    placed, _ = running(rows.orderBy(*order).withColumn("__one", F.lit(1)), "__one", out, "numbered")
    return placed.withColumn(out, F.col(out) + start).drop("__one")


def retyped(files: DataFrame, types: dict[str, str]) -> DataFrame:
    """The type that the extension says, where it is known and differs."""
    wanted = F.coalesce(*[F.when(F.lower("extension") == e, t) for e, t in types.items()])
    return set_where(files, wanted.isNotNull() & ~wanted.eqNullSafe(F.col("file_type")), file_type=wanted)
