"""Exact duplicates by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised texts (``repartitionByRange`` samples the keys and picks the bounds),
Spark's external sort orders each range, and the window operator walks the sorted rows comparing the whole key of each
row with its neighbour.  The splitters are drawn over each text's first bytes and its hash, so that the sampled keys stay
small however long the texts are; whole texts decide the order and equality.  A salt drawn from the id follows the text in
the sort key, so that the splitters may fall inside a group of copies.  There is a salt for every ``salt_rows`` rows of the
table, so that a text that holds a third of all rows spreads over as many neighbouring runs of some hundred rows as the
table's size asks for.  Only one small row a run (digest, salt, smallest id, count) goes on to be combined across runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, table, written


SALT_ROWS = 512  # rows of the table for each salt


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if identical after each run of ASCII white space became one space.  Null text: empty text.  Null id:
    sorts after every other id, so it stays only in a group without ids (``keep_id`` null).  Rows that repeat an id and
    text are one group; exactly one of them has ``kept``.  An empty table gives an empty result.  Other columns are not
    read, whatever their names.
    """
    salts = -(-docs.count() // salt_rows) or 1
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ").alias("t"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("long").alias("salt"),
    )
    # the range keys are part of the sort key, so equal texts of a salt are in one range and adjacent
    rows = rows.withColumn("head", F.substring("t", 1, 32)).withColumn("hash", F.xxhash64("t"))
    run = Window.partitionBy("head", "hash", "t", "salt")
    marks = written(
        rows.repartitionByRange("head", "hash", "salt")
        .withColumn("at", F.row_number().over(run.orderBy(F.col("id").asc_nulls_last())))
        .withColumn("low", F.min("id").over(run))
        .withColumn("n", F.count(F.lit(1)).over(run))
        .select("id", "salt", "at", "low", "n", F.unhex(F.sha2("t", 256)).alias("digest")),
        "sorted",
    )
    runs = marks.filter("at = 1").select("digest", "salt", "low", "n")
    # the run with the smallest id; ids that are null come last
    whole = runs.groupBy("digest").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "salt")).alias("first"), F.sum("n").alias("group_size"))
    ends = runs.select("digest", "salt").join(whole, "digest")
    return marks.join(ends, ["digest", "salt"]).select(
        F.col("id").alias(id_col),
        F.col("first.low").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("at") == 1) & (F.col("salt") == F.col("first.salt"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all ``documents``; null is empty, white space runs are one space, the smallest doc_id stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.s) AS text_sha256
FROM t JOIN g ON t.s = g.s
"""
