"""The row-local operators on streams, and feedback as an append-only vote log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from siftwell.functions.fingerprint import simhash_md5
from siftwell.operators.config import DEFAULT, Config
from siftwell.operators.scoring import assess


def scored_stream(content: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Assessments of a stream of content without reputation: no state and no shuffle."""
    return assess(content, None, cfg)


def vote_log(feedback: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends votes (seq, tenant, fp, verdict) of feedback (seq, tenant, text, verdict) to Parquet; texts are dropped."""
    votes = feedback.select("seq", "tenant", simhash_md5("text").alias("fp"), "verdict")
    return votes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
