"""Aggregations over the catalogue: one pass each, partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT_TYPES = ("PDF", "WORD", "EXCEL", "POWERPOINT", "TEXT")


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _bytes(condition: Column, size: str = "size_bytes") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(size)).otherwise(0)), F.lit(0)).cast("long")


def share(part: Column, whole: Column) -> Column:
    """Percent, half up to two decimals; zero of nothing."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, 2)).otherwise(F.lit(0.0))


def library_summary(files: DataFrame) -> DataFrame:
    """Counts and bytes of active files by kind; ``deleted`` alone counts the deleted ones."""
    up = F.col("lifecycle_status") == "ACTIVE"
    kinds = {"photos": F.col("file_type") == "PHOTO", "videos": F.col("file_type") == "VIDEO", "audios": F.col("file_type") == "AUDIO", "documents": F.col("file_type").isin(*DOCUMENT_TYPES), "others": F.col("file_type") == "OTHER"}
    out = [_count(up).alias("total_files"), _bytes(up).alias("total_bytes"), _count(F.col("lifecycle_status") == "DELETED").alias("deleted")]
    for name, kind in kinds.items():
        out += [_count(up & kind).alias(name), _bytes(up & kind).alias(f"{name}_bytes")]
    return files.agg(*out)


def codec_statistics(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Per codec (trimmed, upper case): present and missing files, share of the present, bytes."""
    rows = files.join(videos, files["id"] == videos["file_id"]).select(F.upper(F.trim("codec")).alias("codec"), (F.col("lifecycle_status") != "MISSING").alias("here"), "size_bytes").filter("codec <> ''")
    each = rows.groupBy("codec").agg(_count(F.col("here")).alias("files"), _count(~F.col("here")).alias("missing"), _bytes(F.col("here")).alias("bytes"))
    return _with_share(each, "files").orderBy(F.desc("files"), F.desc("bytes"), "codec")


def _with_share(each: DataFrame, part: str, out: str = "percent") -> DataFrame:
    """The share of each row in the sum of all: a one-row total joined by broadcast."""
    total = each.agg(F.sum(part).alias("__total"))
    return each.crossJoin(F.broadcast(total)).withColumn(out, share(F.col(part), F.col("__total"))).drop("__total")


def extension_statistics(files: DataFrame, top: int) -> DataFrame:
    rows = files.filter((F.col("lifecycle_status") == "ACTIVE") & (F.trim("extension") != ""))
    each = rows.groupBy(F.lower("extension").alias("extension"), "file_type").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return _with_share(each, "files").orderBy(F.desc("files"), F.desc("bytes"), "extension", "file_type").limit(top)


def folder_statistics(files: DataFrame, locations: DataFrame, top: int, by: str = "bytes") -> DataFrame:
    """Folders by bytes or by files, whatever the files' state; shares are of all files, also those without a folder."""
    rows = files.join(locations, files["id"] == locations["file_id"], "left")
    each = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), _count(F.col("file_type") == "PHOTO").alias("photos"), _count(F.col("file_type") == "VIDEO").alias("videos"), _count(F.col("file_type").isin(*DOCUMENT_TYPES)).alias("documents"))
    shared = _with_share(each, by).filter(F.trim("folder") != "")
    second = "files" if by == "bytes" else "bytes"
    return shared.orderBy(F.desc(by), F.desc(second), "folder").limit(top)


def month_counts(files: DataFrame, metadata: DataFrame, kinds: tuple[str, ...] = ("PHOTO", "VIDEO")) -> DataFrame:
    rows = _dated(files, metadata, kinds).filter("capture_date IS NOT NULL")
    return rows.groupBy(F.year("capture_date").alias("year"), F.month("capture_date").alias("month")).agg(F.count(F.lit(1)).alias("files"))


def _dated(files: DataFrame, metadata: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return files.filter((F.col("lifecycle_status") == "ACTIVE") & F.col("file_type").isin(*kinds)).join(metadata, files["id"] == metadata["file_id"])


def year_rollup(months: DataFrame) -> DataFrame:
    """Years with their months nested, newest first."""
    return months.groupBy("year").agg(F.sum("files").alias("files"), F.sort_array(F.collect_list(F.struct("month", F.col("files").alias("n"))), asc=False).alias("months"))


def dated_summary(files: DataFrame, metadata: DataFrame, kinds: tuple[str, ...] = ("PHOTO", "VIDEO")) -> DataFrame:
    return _dated(files, metadata, kinds).agg(F.count(F.lit(1)).alias("total"), F.count("capture_date").alias("dated"), (F.count(F.lit(1)) - F.count("capture_date")).alias("undated"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; null is a key of its own."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_files_by_error(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").agg(F.countDistinct("path").alias("files"))


def error_details(errors: DataFrame, contains: str | None, offset: int, size: int) -> DataFrame:
    rows = errors if contains is None else errors.filter(F.lower("path").contains(contains.lower()))
    each = rows.groupBy("path", "error_type").agg(F.count(F.lit(1)).alias("n"), F.min("happened_at").alias("first_at"), F.max("happened_at").alias("last_at"))
    return each.orderBy(F.desc("n"), "path", F.asc_nulls_last("error_type")).offset(offset).limit(size)


def folder_summary(files: DataFrame, locations: DataFrame, folder: str) -> DataFrame:
    """Files, distinct folders and bytes below a folder, the folder itself included."""
    return _below(files, locations, folder).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("folder").alias("folders"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.greatest(F.countDistinct("folder") - 1, F.lit(0)).cast("long").alias("subfolders"))


def _below(files: DataFrame, locations: DataFrame, folder: str) -> DataFrame:
    own = F.lower(F.translate("folder", "\\", "/"))
    root = folder.replace("\\", "/").rstrip("/").lower()
    rows = files.filter(F.col("lifecycle_status") == "ACTIVE").join(locations, files["id"] == locations["file_id"])
    return rows.filter((own == root) | own.startswith(root + "/"))


def folder_signature(files: DataFrame, locations: DataFrame, folder: str) -> DataFrame:
    """Count and newest change: if either moves, a stored plan is stale."""
    return _below(files, locations, folder).agg(F.count(F.lit(1)).alias("files"), F.max("updated_at").alias("newest"))


def phase_pivot(phases: DataFrame, executions: list[int]) -> DataFrame:
    """Milliseconds by phase and execution, zero where a run has no such phase, and the largest cell."""
    some = phases.filter(F.col("execution_id").isin(executions))
    wide = some.groupBy("phase").pivot("execution_id", executions).agg(F.sum("millis")).na.fill(0)
    named = wide.select("phase", *[F.col(f"`{e}`").alias(f"e{e}") for e in executions])
    return named.withColumn("largest", F.greatest(*[F.col(f"e{e}") for e in executions]) if len(executions) > 1 else F.col(f"e{executions[0]}"))


def throughput(found: Column, moved: Column, millis: Column) -> Column:
    """Files a second; zero without a duration."""
    return F.when(millis > 0, F.greatest(found, moved) * F.lit(1000.0) / millis).otherwise(F.lit(0.0))


def telemetry(executions: DataFrame, metrics: DataFrame, keep_unmeasured: bool = False) -> DataFrame:
    return executions.join(metrics, executions["id"] == metrics["execution_id"], "left" if keep_unmeasured else "inner").drop("execution_id")


def progress(executions: DataFrame, counters: list[str]) -> DataFrame:
    """Per status: executions, and the sums of their counters (unknown ones count nothing)."""
    return executions.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters])


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")


def canonical_digest(rows: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """SHA-256 of each group's ordered entries, each as name and value with their UTF-8 lengths in front."""
    piece = F.concat(F.octet_length(name), F.lit(":"), F.col(name), F.octet_length(value), F.lit(":"), F.col(value))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(piece)), ""), 256).alias("digest"))


def trimmed_mean(scores: Column, drop: int) -> Column:
    """The rounded mean without the lowest ``drop`` scores; at least one stays."""
    ordered = F.sort_array(scores)
    skip = F.least(F.lit(drop), F.size(scores) - 1)
    left = F.slice(ordered, skip + 1, F.size(scores))
    total = F.aggregate(left, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(scores) > 0, F.floor(total / F.size(left) + 0.5).cast("int"))
