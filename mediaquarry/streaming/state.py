"""Operators with state across micro-batches: renames whose halves come apart, and changes that the system made itself.

Both keep their state in the state store, in event time: what waits is decided when the watermark has passed it, so the result
doesn't depend on how rows are dealt to batches.  Renames need a provider that knows timers; for a join's state, one that
need not hold it in memory is wanted too (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .changes import MATERIAL, RENAMED_NEW, RENAMED_OLD


def use_state_store(spark: SparkSession) -> None:
    """Sets the session's state store to the one that holds timers and lists."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(at: datetime) -> int:
    return round(at.timestamp() * 1_000_000)


class Renames(StatefulProcessor):
    """Per file: an old name waits for its new one.  Output: (path, action)."""

    def __init__(self, root: str, wait_ms: int):
        self.root, self.wait_ms = root, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.old = handle.getValueState("old", "path string, directory boolean, due long")

    def _below(self, path: str | None) -> bool:
        return path is not None and path.lower().startswith(self.root.lower().rstrip("/\\") + "/")

    def _gone(self, old: Row) -> Iterator[Row]:
        if self._below(old.path):
            yield Row(path=self.root, action="RECONCILE") if old.directory else Row(path=old.path, action="CHECK")

    def _forget(self, old: Row) -> None:
        self.handle.deleteTimer(old.due)
        self.old.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a file's changes of one batch
        for x in sorted(rows, key=lambda r: r.seq):
            held = Row("path", "directory", "due")(*self.old.get()) if self.old.exists() else None
            if x.reason_flags & RENAMED_OLD:
                if held:
                    yield from self._gone(held)
                    self._forget(held)
                due = max(_micros(x.happened_at) // 1000 + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1)
                self.old.update((x.path, x.directory, due))
                self.handle.registerTimer(due)
            elif x.reason_flags & RENAMED_NEW:
                if x.directory or (held and held.directory):
                    if self._below(x.path) or (held and self._below(held.path)):
                        yield Row(path=self.root, action="RECONCILE")
                else:
                    for path in ([held.path] if held else []) + [x.path]:
                        if self._below(path):
                            yield Row(path=path, action="CHECK")
                if held:
                    self._forget(held)
            elif not x.directory and self._below(x.path):
                yield Row(path=x.path, action="CHECK")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.old.exists():
            held = Row("path", "directory", "due")(*self.old.get())
            if held.due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._gone(held)
                self.old.clear()

    def close(self) -> None:
        pass


def interpreted(journal: DataFrame, root: str, late: str = "10 seconds", wait_ms: int = 10_000) -> DataFrame:
    """(path, action) out of a streaming journal: what ``changes.interpreted`` gives for the same rows in one batch.

    The two halves of a rename may be batches apart; an old name whose new one doesn't come within ``wait_ms`` of event time
    is reported as gone.  A path may be reported again in a later batch.
    """
    material = F.col("reason_flags").bitwiseAND(F.lit(MATERIAL)) != 0
    rows = journal.filter(material).select("file_ref", "seq", "path", "reason_flags", F.coalesce("directory", F.lit(False)).alias("directory"), F.col("happened_at").cast("timestamp").alias("happened_at"))
    return rows.withWatermark("happened_at", late).groupBy("file_ref").transformWithState(Renames(root, wait_ms), "path string, action string", "append", "eventTime")


def foreign(changes: DataFrame, announced: DataFrame, expiry_ms: int = 300_000, ahead_ms: int = 10_000, late: str = "1 minute") -> DataFrame:
    """(path, at, id) of the streaming changes (id long, path, at) that no announcement (path, at) of another stream covers.

    An announcement covers changes from ``ahead_ms`` before it to ``expiry_ms`` after it; a writer that still runs announces
    its paths again (``prolonged``).  A change is decided when the watermark has passed it by ``ahead_ms``: rows may come
    in any order within ``late``, and the result is that of ``changes.foreign`` on all rows at once.

    An outer join of the streams.  Its key is the path and a slot of time as long as what an announcement covers, so that a change
    only meets announcements of about its time, however many its path has.
    """
    slot = lambda micros: F.floor(micros / F.lit(max(1, expiry_ms + ahead_ms) * 1000))
    told = changes.select("path", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id")).withWatermark("at", late)
    own = announced.select(F.col("path").alias("own_path"), F.col("at").cast("timestamp").alias("own_at")).withWatermark("own_at", late)
    micros = F.unix_micros("own_at")
    own = own.withColumn("own_slot", F.explode(F.sequence(slot(micros - F.lit(ahead_ms * 1000)), slot(micros + F.lit(expiry_ms * 1000)))))
    span = lambda ms: F.expr(f"INTERVAL '{ms / 1000:.3f}' SECOND")
    covered = (F.col("own_path") == F.col("path")) & (F.col("own_slot") == F.col("slot")) & (F.col("at") >= F.col("own_at") - span(ahead_ms)) & (F.col("at") <= F.col("own_at") + span(expiry_ms))
    return told.withColumn("slot", slot(F.unix_micros("at"))).join(own, covered, "left_outer").filter("own_path IS NULL").select("path", "at", "id")


def prolonged(heartbeats: DataFrame, plans: DataFrame) -> DataFrame:
    """Announcements anew: each path that a writer announced (``plans``, a table: execution_id, path), at each of its heartbeats
    (a stream: execution_id, at)."""
    return heartbeats.join(plans.select("execution_id", "path").distinct(), "execution_id").select("path", "at")
