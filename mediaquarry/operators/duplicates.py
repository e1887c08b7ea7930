"""Exact duplicates by content hash, and the policy that ranks what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import trust
from ..functions.predicates import without_excluded_folders

# Subcategories of copies, and date sources that only untouched metadata gives.
DERIVATIVES = ("WHATSAPP", "AIRBRUSH", "PHOTOGRID", "SCREENSHOT")
EMBEDDED = ("EXIF", "MEDIA_INFO")


def eligible(files: DataFrame, locations: DataFrame, file_exclusions: DataFrame, folder_exclusions: DataFrame, types: tuple[str, ...] | None = None, need_folder: bool = False) -> DataFrame:
    """Active files with a hash that no exclusion names, with their folder."""
    rows = files.filter((F.col("lifecycle_status") == "ACTIVE") & (F.trim("sha256") != ""))
    if types:
        rows = rows.filter(F.col("file_type").isin(*types))
    placed = rows.join(locations.select(F.col("file_id").alias("__f"), "folder"), F.col("id") == F.col("__f"), "inner" if need_folder else "left").drop("__f")
    return without_excluded_folders(placed.join(file_exclusions, "public_id", "left_anti"), folder_exclusions, "folder", "folder")


def groups(rows: DataFrame) -> DataFrame:
    """Contents that more than one file has; wasted: all bytes but the smallest file's."""
    each = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), (F.sum("size_bytes") - F.min("size_bytes")).alias("wasted"))
    return each.filter("files > 1").orderBy(F.desc("wasted"), "sha256")


def summary(rows: DataFrame) -> DataFrame:
    return groups(rows).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def candidates(rows: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of groups with their files; the page bounds the side that is joined."""
    page = groups(rows).offset(offset).limit(size).select("sha256", "files", "wasted")
    return rows.join(F.broadcast(page), "sha256")


def is_derivative(subcategory: Column) -> Column:
    return F.coalesce(subcategory.isin(*DERIVATIVES), F.lit(False))


def original_signals(has_camera: Column, date_source: Column, subcategory: Column) -> Column:
    """Metadata as the camera wrote it, and in no subcategory of copies."""
    return (F.coalesce(has_camera, F.lit(False)) | F.coalesce(date_source.isin(*EMBEDDED), F.lit(False))) & ~is_derivative(subcategory)


def keep_ranking(rows: DataFrame, group: str, exact: bool) -> DataFrame:
    """Each file's verdict: KEEP, DELETE_CANDIDATE or REVIEW, and its reason.

    ``rows``: group, file_id, has_camera, subcategory, width, height, date_source, capture_date.  Order: originals, files of
    no subcategory of copies, pixels (unknown: none), trust of the date, earliest date (unknown last), id.  A group is sure
    if it is exact or has exactly one original; otherwise its other files are for review.
    """
    c = F.col
    pixels = F.coalesce(c("width").cast("long") * c("height"), F.lit(0))
    marked = rows.withColumn("original", original_signals(c("has_camera"), c("date_source"), c("subcategory")))
    best = Window.partitionBy(group).orderBy(F.desc("original"), is_derivative(c("subcategory")), F.desc(pixels), F.desc(trust(c("date_source"), c("capture_date"))), F.asc_nulls_last("capture_date"), "file_id")
    whole = Window.partitionBy(group)
    ranked = marked.withColumn("place", F.row_number().over(best)).withColumn("originals", F.sum(c("original").cast("int")).over(whole))
    sure = F.lit(True) if exact else c("originals") == 1
    verdict = F.when(c("place") == 1, "KEEP").when(sure, "DELETE_CANDIDATE").otherwise("REVIEW")
    kept = F.when(c("original"), "ORIGINAL").when(sure, "BEST_IN_GROUP").otherwise("REVIEW_NO_CLEAR_ORIGINAL")
    copy = F.when(c("subcategory") == "WHATSAPP", "WHATSAPP_COPY").when(c("subcategory").isin("AIRBRUSH", "PHOTOGRID"), "EDITED_COPY").otherwise("IDENTICAL_COPY" if exact else "DERIVATIVE")
    reason = F.when(c("place") == 1, kept).when(sure, copy).otherwise("REVIEW_NO_CLEAR_ORIGINAL")
    return ranked.withColumn("verdict", verdict).withColumn("reason", reason)


def wasted_bytes(verdicts: DataFrame, group: str) -> DataFrame:
    return verdicts.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("verdict") == "DELETE_CANDIDATE", F.col("size_bytes"))), F.lit(0)).alias("wasted"))
