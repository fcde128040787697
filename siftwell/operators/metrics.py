"""Calibration and ranking metrics of labelled scores: DataFrames (score double in 0..1, label boolean), grouped or not.

Every metric aggregates partially before its shuffle; none collects scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.sinks import staged

#: The sweep's thresholds and the number of calibration bins.
SWEEP, BINS = (0.50, 0.70, 0.80, 0.90, 0.95), 10


def in_unit(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be finite and within 0..1, got {threshold}")
    return threshold


def invalid_scores(df: DataFrame) -> DataFrame:
    """The rows whose score isn't finite and within 0..1."""
    return df.where(~in_unit(F.col("score")))


def counts(threshold: Column) -> list[Column]:
    hit, yes = F.col("score") >= threshold, F.col("label")
    return [F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn")]


def with_prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1: null where undefined, f1 0 where both are 0."""
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    df = df.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(both.isNotNull(), 0.0))


def confusion(df: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*counts(F.lit(check_threshold(threshold))))


def sweep(df: DataFrame, thresholds=SWEEP, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 at each threshold; each row is expanded to the thresholds once."""
    wide = df.withColumn("threshold", F.explode(F.array(*(F.lit(check_threshold(t)) for t in thresholds))))
    return with_prf(wide.groupBy(*by, "threshold").agg(*counts(F.col("threshold"))))


def brier(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label").cast("int"), 2)).alias("brier"))


def ece(df: DataFrame, by: tuple[str, ...] = (), ranges: bool = False) -> DataFrame:
    """Expected calibration error over ten bins; ``ranges`` takes bins b/10 <= score < (b+1)/10 instead of floors.

    The two differ only where a score times ten rounds up to a whole number.
    """
    floor = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    if ranges:
        floor = F.lit(0)
        for b in range(1, BINS):
            floor = F.when(F.col("score") >= b / BINS, b).otherwise(floor)
    binned = df.groupBy(*by, floor.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.col("label").cast("int")).alias("p"))
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("p"))) / F.sum("n")).alias("ece"))


def average_precision(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under precision over recall with ties taken together; null without positives."""
    return precision_of(staged(tallied(df, by), "tally"), by)


def precision_of(tally: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``average_precision`` of a tally (by, score, n, pos).

    Running counts are sums of two levels, within the slices of the score range and over the slices before, so no task
    needs all scores.
    """
    by_score = tally.withColumn("slice", F.floor(F.col("score") * 4096).cast("int"))
    slices = by_score.groupBy(*by, "slice").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp"))
    above = Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.desc("slice"))
    slices = slices.select(*by, "slice", (F.sum("sn").over(above) - F.col("sn")).alias("n0"), (F.sum("sp").over(above) - F.col("sp")).alias("p0"))
    within = Window.partitionBy(*by, "slice").orderBy(F.desc("score"))
    run = by_score.withColumns({"cn": F.sum("n").over(within), "cp": F.sum("pos").over(within)}).join(slices, [*by, "slice"])
    return run.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("p0") + F.col("cp")) / (F.col("n0") + F.col("cn"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def tallied(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, score, n, pos): rows and positive rows of each distinct score, from which all metrics follow."""
    return df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.count_if("label").alias("pos"))


def signal_metrics(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of all metrics: labelled, positive, negative, brier, ece, average_precision and the counts at ``threshold``.

    One pass over ``df`` tallies its scores; the metrics are aggregates of the tally.
    """
    tally = staged(tallied(df, by), "tally")
    hit, n, pos, neg = F.col("score") >= check_threshold(threshold), F.col("n"), F.col("pos"), F.col("n") - F.col("pos")
    when = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast("long"))
    base = tally.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("labelled"), F.coalesce(F.sum(pos), F.lit(0).cast("long")).alias("positive"), F.coalesce(F.sum(neg), F.lit(0).cast("long")).alias("negative"),
        when(hit, pos).alias("tp"), when(hit, neg).alias("fp"), when(~hit, neg).alias("tn"), when(~hit, pos).alias("fn"),
        (F.sum(pos * F.pow(1 - F.col("score"), 2) + neg * F.pow("score", 2)) / F.sum(n)).alias("brier"),
    )
    bins = tally.groupBy(*by, F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.sum(n * F.col("score")).alias("s"), F.sum("pos").alias("p"))
    error = bins.groupBy(*by).agg((F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n")).alias("ece"))
    out = with_prf(base)
    for part in (error, precision_of(tally, by)):
        out = out.join(part, list(by)) if by else out.crossJoin(part)  # one row each
    return out


def evaluate(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``signal_metrics`` by signal of assessed records (spam, slop and labels spam_label, slop_label, null if unlabelled)."""
    long = records.select(F.expr("stack(2, 'spam', spam, spam_label, 'slop', slop, slop_label) AS (signal, score, label)")).where("label IS NOT NULL")
    return signal_metrics(long, threshold, ("signal",))


def compared(df: DataFrame, by: str, trained: str, baseline: str) -> DataFrame:
    """``signal_metrics`` of each classifier in ``by`` with default_eligible: whether ``trained`` has both the lower Brier
    score and the higher average precision than ``baseline``."""
    found = staged(signal_metrics(df, by=(by,)), "compared")
    pick = lambda who, what: F.max(F.when(F.col(by) == who, F.col(what)))
    better = found.agg((pick(trained, "brier") < pick(baseline, "brier")).alias("_b"), (pick(trained, "average_precision") > pick(baseline, "average_precision")).alias("_a"))
    return found.crossJoin(better).withColumn("default_eligible", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")  # one row
