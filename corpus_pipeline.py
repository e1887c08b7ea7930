"""A document pipeline of the training-data operators: (name, function) stages over the documents table.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the
shared folder and reads it again as the next one's documents.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from mediaquarry.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learnt from the labels of this stage's own documents.

    Null and empty texts have no hit and stay; repeated rows are judged alike, and without labels nothing goes.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words and more go, and documents of which nothing is left; n_chars follows.

    Null and empty texts stay as they are; of equal runs the one with the lowest id, text hash and line stays, and rows that repeat an
    id and its text are treated alike.
    """
    cleaned = line_dedup.deduplicate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Near copies: fingerprints of five-word shingles at most three bits apart; or texts whose MinHash sketches agree in 14 of
    24 values and that are within seven bits or share 0.8 of their shingles.
    """
    return simhash.keep_one(docs, shingle=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; null texts are empty, repeated rows give equal rows."""
    return bpe.encode(docs, digest=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding", encode),
]
#: Stages of the pipeline have no SQL form (tests hold it against a brute-force version).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
