"""Search and look-ups over the catalogue's tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p


@dataclass
class Filters:
    """Every field is optional."""

    file_type: str | None = None
    extension: str | None = None
    folder_part: str | None = None
    codec: str | None = None
    category: str | None = None
    subcategory: str | None = None
    manufacturer: str | None = None
    year: int | None = None
    month: int | None = None
    least_bytes: int | None = None
    most_bytes: int | None = None
    longest_side: int | None = None
    first_day: date | None = None
    last_day: date | None = None
    geo: str | None = None


def condition(f: Filters) -> Column:
    c, o = F.col, p.optional
    return p.every(
        o(f.file_type, lambda v: c("file_type") == v), o(f.extension, lambda v: F.lower("extension") == v.lower()), o(f.folder_part, lambda v: p.contains_ci(c("folder"), v)),
        o(f.codec, lambda v: F.upper(F.trim("codec")) == v.strip().upper()), o(f.category, lambda v: c("category") == v), o(f.subcategory, lambda v: c("subcategory") == v),
        o(f.manufacturer, lambda v: p.prefix_ci(c("manufacturer"), v)), o(f.year, lambda v: F.year("capture_date") == v), o(f.month, lambda v: F.month("capture_date") == v),
        o(f.least_bytes, lambda v: c("size_bytes") >= v), o(f.most_bytes, lambda v: c("size_bytes") <= v), o(f.longest_side, lambda v: p.longest_side(c("width"), c("height"), v)),
        p.day_window(c("capture_date"), f.first_day, f.last_day), p.presence(c("country_name"), f.geo),
    )


def media_rows(files: DataFrame, locations: DataFrame, metadata: DataFrame, videos: DataFrame, places: DataFrame) -> DataFrame:
    """Active files with every satellite, missing ones null."""
    out = files.filter(p.active(F.col("lifecycle_status")))
    for other in (locations, metadata, videos.select("file_id", "codec", "duration"), places):
        out = out.join(other.withColumnRenamed("file_id", "__f"), F.col("id") == F.col("__f"), "left").drop("__f")
    return out


def search(rows: DataFrame, f: Filters) -> DataFrame:
    return rows.filter(condition(f))


def latest_location(files: DataFrame, locations: DataFrame) -> DataFrame:
    """Each file's newest location (by path, where there are several)."""
    last = locations.groupBy("file_id").agg(F.max("path").alias("path"))
    return files.join(last, files["id"] == last["file_id"], "left").drop("file_id")


def of_folder(files: DataFrame, locations: DataFrame, folder: str) -> DataFrame:
    """Active files right in a folder, case ignored."""
    here = locations.filter(F.lower("folder") == folder.lower())
    return files.filter("lifecycle_status = 'ACTIVE'").join(here, files["id"] == here["file_id"]).drop("file_id").orderBy("file_name", "id")


def explorer(rows: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Folders first, then by name (case ignored) or date (unknown last), then the missing."""
    key = F.lower("name") if by == "name" else F.col("modified_at")
    order = (key.desc_nulls_last() if descending else key.asc_nulls_last())
    return rows.orderBy(F.desc("is_folder"), order, F.asc("missing"), "name")


def pending(files: DataFrame, prints: DataFrame, failures: DataFrame, file_type: str, budget: int) -> DataFrame:
    """Active files of a type without a fingerprint and without a used-up failure budget."""
    spent = failures.filter(F.col("attempts") >= budget)
    todo = files.filter((F.col("lifecycle_status") == "ACTIVE") & (F.col("file_type") == file_type))
    return todo.join(prints, todo["id"] == prints["file_id"], "left_anti").join(spent, todo["id"] == spent["file_id"], "left_anti")


def conversion_candidates(files: DataFrame, videos: DataFrame, output: str = "mp4", modern: tuple[str, ...] = ("HEVC", "H265", "AV1")) -> DataFrame:
    """Videos in another container, of unknown codec or of none of the modern ones; the largest first."""
    rows = files.filter("lifecycle_status = 'ACTIVE' AND file_type = 'VIDEO'").join(videos, files["id"] == videos["file_id"], "left").drop("file_id")
    wanted = (F.lower("extension") != output) | F.col("codec").isNull() | ~F.upper(F.trim("codec")).isin(*modern)
    return rows.filter(F.coalesce(wanted, F.lit(True))).orderBy(F.desc("size_bytes"), F.desc("id"))


def first_of_group(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): the value of each group's first row in the given order; partial sums before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def first_of_run(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each run of equal keys."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")


def stale_metadata(files: DataFrame, metadata: DataFrame, cutoff: Column, category: str | None, has_date: bool | None) -> DataFrame:
    """Ids whose metadata is due: never rebuilt or before the cutoff."""
    rows = files.filter("lifecycle_status = 'ACTIVE'").join(metadata, files["id"] == metadata["file_id"], "left")
    return rows.filter(p.every(p.optional(category, lambda v: F.col("category") == v), p.tri_state(F.col("capture_date"), has_date), p.stale_or_never(F.col("rebuilt_at"), cutoff))).select("id")
