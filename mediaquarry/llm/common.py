"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that does not clash with any of ``taken`` (case-insensitively)."""
    used = {c.lower() for c in taken}
    name = base
    while name.lower() in used:
        name = f"_{name}"
    return name


def crc32_of(column: str) -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session.  Only where it is unset (tests on a local master) is a temporary folder taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
            found = tempfile.mkdtemp(prefix="mediaquarry-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/mediaquarry-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again (an executor's loss costs nothing)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` if its rows come straight from files, else a written copy: so that ``row_place`` names each row in every job.

    (A row's number in its partition wouldn't do: splits depend on how many executors there are when a job starts.)
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return df
    except AnalysisException:
        return written(df, "stored")


def row_place() -> Column:
    """A hash of a stored row's file and its number there."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"]


#: Keys that hold more than one row in HOT are broadcast: at most HOT of them can exist.
HOT = 4096


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Left join of ``groups`` (one row a key, with its number of rows in ``size``) to ``rows``, safe under any skew.

    ``groups`` should be a written table.  Keys with more than 1/HOT of the rows are fewer than HOT by arithmetic and are
    broadcast; their rows then leave the shuffled join's key for ``spread``, so that no task gets a hot group.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    hot, rest = groups.filter(F.col(size) * HOT > total), groups.filter(F.col(size) * HOT <= total)
    own = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(hot.select(key, F.struct(*own).alias("__hot"))), key, "left")
    moved = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread)
    far = rest.select(F.col(key).alias("__key"), F.struct(*own).alias("__rest"))
    joined = near.withColumn("__at", moved).join(far, F.col("__at") == F.col("__key"), "left")
    found = F.coalesce("__hot", "__rest")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in own])
