"""A training corpus from raw documents: quality, near-duplicates, decontamination, mixture, token shards.

Every stage takes whole texts of any length, passes columns of any name through and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import shared_dir, table
from siftwell.llm.decontaminate import drop_contaminated
from siftwell.llm.mixture import arranged
from siftwell.llm.quality import drop_low_quality
from siftwell.llm.simhash import drop_near_duplicates
from siftwell.llm.tokens import WINDOW, write_shards

#: SQL can't express the classifier, the fingerprints or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality ranking rejects; all rows and columns of the others stay, repeated ones too.

    Null and empty texts are ranked like any other, ties alike; without labels of both classes all documents stay.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest doc_id, of repeated rows one.

    Null and empty texts are one group; rows that repeat an id with another text are documents of their own.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item; null and empty texts overlap with none and stay.

    Repeated rows go or stay together; with an empty benchmark all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target weight, documents repeated as often as that asks, in training order.

    Null and empty texts have no words to take and go. A null source is one of its own, rows without an id are taken by
    their text, ties of the order go by id and size.
    """
    return arranged(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns their sequences.

    Documents are taken in the order of their rows in the files of the stage before, which is that of training, and
    sequences are permuted within windows of it. Null and empty texts are an end mark, repeated rows are encoded again.
    """
    return write_shards(docs, shared_dir(spark, "corpus"), window=WINDOW, files=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_shards", token_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
