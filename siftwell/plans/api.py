"""Entry points over files and frames: check, evaluate a labelled corpus, export features, take feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.fingerprint import network_fp_sip, simhash_md5, simhash_sip
from siftwell.functions.text import MODEL_INPUTS
from siftwell.operators import limits, metrics, training
from siftwell.operators.config import DEFAULT, Config
from siftwell.operators.feedback import check_secret
from siftwell.operators.scoring import Stores, assess
from siftwell.sources import readers
from siftwell.sources.sinks import staged, write_json


def sound_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON-lines corpus; raises with the line of the first fault, and on an empty corpus."""
    records = staged(readers.parsed_records(readers.numbered_lines(spark, path)), "records")
    fault = readers.first_error(records).first()
    if fault:
        raise ValueError(f"line {fault.line}: {fault.error}")
    if records.isEmpty():
        raise ValueError("the corpus holds no records")
    return records


def check(requests: DataFrame, stores: Stores | None = None, cfg: Config = DEFAULT, params: dict | None = None) -> DataFrame:
    """Requests (text, and author_email and author_ip if present) with spam, slop and reasons; other columns pass through."""
    names = {"author_email": "email", "author_ip": "ip"}
    renamed = requests.withColumnsRenamed({k: v for k, v in names.items() if k in requests.columns})
    out = assess(renamed, stores, cfg, params)
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(*requests.columns, "spam", "slop", "reasons")


def check_batches(batches: DataFrame, **options) -> DataFrame:
    """(batch, item, spam, slop, reasons) of batches (batch, items array of requests); raises on one over the cap."""
    capped = batches.withColumn("items", F.when(F.size("items") <= limits.BATCH_ITEMS, F.col("items")).otherwise(F.raise_error(F.lit("a batch holds too many items")).cast(batches.schema["items"].dataType)))
    rows = capped.select("batch", F.posexplode("items").alias("item", "r")).select("batch", "item", "r.*")
    return check(rows, **options).select("batch", "item", "spam", "slop", "reasons").orderBy("batch", "item")


def votes_of(feedback: DataFrame, kind: str = "md5", secret: str | None = None) -> DataFrame:
    """Votes (seq, tenant, fp, verdict) of feedback (seq, tenant, text, verdict); raises on a text over the cap, keeps none.

    ``kind`` is the hash of the fingerprints; with a ``secret`` they are keyed for the network's store.
    """
    text = F.when(F.octet_length("text") <= limits.FEEDBACK_BYTES, F.col("text")).otherwise(F.raise_error(F.lit("a feedback text is too long")).cast("string"))
    own = {"md5": simhash_md5, "sip": simhash_sip}[kind](text)
    return feedback.select("seq", "tenant", (network_fp_sip(own, check_secret(secret.encode()).decode()) if secret else own).alias("fp"), "verdict")


def evaluate(spark: SparkSession, path: str, threshold: float = 0.5, params: dict | None = None) -> DataFrame:
    """Metrics by signal of a labelled corpus, scored without reputation."""
    metrics.check_threshold(threshold)
    records = sound_records(spark, path).withColumnsRenamed({"spam": "spam_label", "slop": "slop_label"})
    return metrics.evaluate(assess(records, params=params), threshold)


def export_spam_features(spark: SparkSession, path: str, source: str, output: str) -> int:
    """Writes the training rows of a corpus' spam-labelled records; raises if there are none. Returns their number."""
    rows = training.export_features(sound_records(spark, path).select("id", "text", F.col("spam").alias("label")), source)
    rows = staged(rows.withColumn("feature_names", F.array(*map(F.lit, MODEL_INPUTS))), "export")
    n = rows.count()
    if not n:
        raise ValueError("the corpus holds no spam labels")
    write_json(rows, output)
    return n
