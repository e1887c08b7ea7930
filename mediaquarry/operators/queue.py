"""The work queue's decisions as queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_BONUS = 5


def claimable(queue: DataFrame, now: datetime, attempts: int, types: list[str]) -> DataFrame:
    """Pending work in the order in which it would be claimed: priority and age (an hour a point, up to five), then id.

    Work whose key is running already waits.
    """
    at = F.lit(now).cast("timestamp_ntz")
    running = queue.filter("status = 'RUNNING' AND dedup_key IS NOT NULL").select(F.col("dedup_key").alias("__busy")).distinct()
    ready = queue.filter((F.col("status") == "PENDING") & (F.col("available_at") <= at) & (F.col("claim_count") < attempts) & F.col("type").isin(types))
    free = ready.join(running, F.col("dedup_key") == F.col("__busy"), "left_anti")
    hours = F.greatest(F.floor((F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600), F.lit(0))
    return free.withColumn("rank", F.col("priority") + F.least(hours, F.lit(HOURS_BONUS))).orderBy(F.desc("rank"), "id")


def lock_conflicts(holders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(holder, wanted): locks on a path that exclude each other: of equal paths, or where one is an ancestor of the other.

    Both: id, path.  A lock is exclusive on its path and shared on all ancestors, so siblings don't exclude each other.
    Every path is expanded to its chain of ancestors, which makes it an equi-join.
    """
    from ..functions import predicates as p

    def sides(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = rows.select(F.col("id").alias(name), p.lock_chain(F.col("path")).alias("chain"))
        return own.select(name, F.element_at("chain", -1).alias("key")), own.select(name, F.explode("chain").alias("key"))

    held, held_chain = sides(holders, "holder")
    want, want_chain = sides(wanted, "wanted")
    return held.join(want_chain, "key").unionByName(held_chain.join(want, "key")).select("holder", "wanted").distinct()


def expired(queue: DataFrame, now: Column) -> DataFrame:
    return queue.filter((F.col("status") == "RUNNING") & (F.col("lease_until") < now))


def requeue(queue: DataFrame, now: Column, attempts: int) -> DataFrame:
    """Expired work goes back to pending, unless its key waits already or its attempts are used up: then it has failed."""
    waiting = queue.filter("status = 'PENDING' AND dedup_key IS NOT NULL").select(F.col("dedup_key").alias("__w")).distinct()
    joined = queue.join(waiting, F.col("dedup_key") == F.col("__w"), "left")
    late = (F.col("status") == "RUNNING") & F.coalesce(F.col("lease_until") < now, F.lit(False))
    again = late & F.col("__w").isNull() & (F.col("claim_count") < attempts)
    status = F.when(again, "PENDING").when(late, "FAILED").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("__w")


def duplicates_of_key(queue: DataFrame) -> DataFrame:
    """Rows that break "one pending and one running a key": all but the first of each."""
    at = F.row_number().over(Window.partitionBy("dedup_key", "status").orderBy("id"))
    return queue.filter("dedup_key IS NOT NULL AND status IN ('PENDING', 'RUNNING')").withColumn("place", at).filter("place > 1")
