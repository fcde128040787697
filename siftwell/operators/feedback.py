"""Tenant feedback on fingerprints: the latest vote of each tenant counts, and three tenants make a consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: tenants below which a fingerprint has no score.
QUORUM = 3
#: Fixed value: what a counter of votes holds at most.
MOST = (1 << 32) - 1
#: Fixed value: the least bytes of a network secret.
SECRET_BYTES = 32


def check_secret(secret: bytes) -> bytes:
    if len(secret) < SECRET_BYTES:
        raise ValueError(f"the network secret needs {SECRET_BYTES} bytes")
    return secret


def latest(votes: DataFrame) -> DataFrame:
    """(fp, tenant, verdict): each tenant's last vote by seq on each fingerprint. ``votes`` has seq, tenant, fp, verdict."""
    return votes.groupBy("fp", "tenant").agg(F.max_by("verdict", "seq").alias("verdict"))


def aggregates(votes: DataFrame) -> DataFrame:
    """(fp, spam, ham, packed) of the latest votes; packed holds spam in the upper 32 bits. Raises where a count needs more."""
    n = latest(votes).groupBy("fp").agg(F.count_if(F.col("verdict") == "spam").alias("spam"), F.count_if(F.col("verdict") == "ham").alias("ham"))
    full = F.raise_error(F.lit("a fingerprint has more votes than its counter holds")).cast("long")
    n = n.withColumns({c: F.when(F.col(c) <= MOST, F.col(c)).otherwise(full) for c in ("spam", "ham")})
    return n.withColumn("packed", F.shiftleft(F.col("spam").cast("long"), 32).bitwiseOR(F.col("ham").cast("long")))


def network_scores(votes: DataFrame) -> DataFrame:
    """(fp, score): the share of spam among the latest votes of QUORUM tenants or more."""
    total = F.col("spam") + F.col("ham")
    return aggregates(votes).where(total >= QUORUM).select("fp", (F.col("spam") / total).alias("score"))


def receipts(votes: DataFrame) -> DataFrame:
    """(seq, changed, distinct_tenants) after each vote in turn."""
    own = Window.partitionBy("fp", "tenant").orderBy("seq")
    before = F.lag("verdict").over(own)
    marked = votes.select("seq", "fp", "tenant", (~F.col("verdict").eqNullSafe(before)).alias("changed"), F.row_number().over(own).alias("nth"))
    upto = Window.partitionBy("fp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("seq", "changed", F.sum((F.col("nth") == 1).cast("long")).over(upto).alias("distinct_tenants"))


def unpacked(tallies: DataFrame) -> DataFrame:
    """(fp, spam, ham) of stored counts (fp, packed)."""
    return tallies.select("fp", F.shiftrightunsigned("packed", 32).alias("spam"), F.col("packed").bitwiseAND(MOST).alias("ham"))


def unknown_verdicts(votes: DataFrame) -> DataFrame:
    return votes.where(~F.coalesce(F.col("verdict").isin("spam", "ham"), F.lit(False)))
