"""Disk against catalogue: differences, renames, and what to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(disk: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(path, id, issue): UNTRACKED, MISSING, STALE (another size) or OK, by a full outer join on the path."""
    d = disk.select("path", F.col("size_bytes").alias("disk_size"), F.lit(True).alias("on_disk"))
    c = catalogue.select("path", "id", F.col("size_bytes").alias("known_size"), F.lit(True).alias("known"))
    joined = d.join(c, "path", "full_outer")
    issue = F.when(F.col("known").isNull(), "UNTRACKED").when(F.col("on_disk").isNull(), "MISSING").when(~F.col("disk_size").eqNullSafe(F.col("known_size")), "STALE").otherwise("OK")
    return joined.select("path", "id", issue.alias("issue"))


def renames(missing: DataFrame, untracked: DataFrame) -> DataFrame:
    """(id, new_path): gone and new files of equal (size, sha256), where that is unambiguous.

    One of each is a pair.  Otherwise a gone file takes the only new one that was created at its time, and of several such
    gone ones the one with the lowest id does; a time that more than one new file has decides nothing, nor does an unknown
    one.  Only counts and minima, so a content that very many files share (the empty one) is no task of its own.
    """
    key = ["size_bytes", "sha256"]
    gone = missing.groupBy(*key).agg(F.count(F.lit(1)).alias("n_gone"), F.min("id").alias("id"))
    new = untracked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_new"), F.min("path").alias("new_path"))
    both = gone.join(new, key)
    direct = both.filter("n_gone = 1 AND n_new = 1").select("id", "new_path")
    many = both.filter("n_gone > 1 OR n_new > 1").select(*key)
    timed = [*key, "created_at"]
    old = missing.filter("created_at IS NOT NULL").groupBy(*timed).agg(F.min("id").alias("id"))
    only = untracked.filter("created_at IS NOT NULL").groupBy(*timed).agg(F.min("path").alias("new_path"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return direct.unionByName(old.join(only, timed).join(many, key, "left_semi").select("id", "new_path"))


def apply_plan(issues: DataFrame, renamed: DataFrame, cap: int | None = None) -> DataFrame:
    """(id, action, new_path): RENAME first, then REFRESH of stale paths, then MARK_MISSING for the rest.

    ``cap`` keeps the sampled issues of the interactive report; None, the default, applies to all.
    """
    open_issues = issues.filter("issue IN ('MISSING', 'STALE')")
    if cap is not None:
        open_issues = open_issues.orderBy("issue", "path").limit(cap)
    joined = open_issues.join(renamed, "id", "left")
    action = F.when(F.col("new_path").isNotNull(), "RENAME").when(F.col("issue") == "STALE", "REFRESH").otherwise("MARK_MISSING")
    return joined.select("id", action.alias("action"), "new_path")
