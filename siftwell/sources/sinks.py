"""Sinks that keep the old result until the new one is whole, and intermediate tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, or a temporary folder where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.gettempdir()
    return f"{base}/siftwell-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that what follows reads it instead of computing it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is read in fewer than 16 tasks: a small table, whose rows cost more than their move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(16, cores) else df


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder if it exists."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def written_beside(df: DataFrame, path: str) -> str:
    """Writes ``df`` as JSON lines beside ``path`` and returns where; leaves nothing there if that fails."""
    new = f"{path}.new-{uuid.uuid4().hex[:8]}"
    try:
        df.write.option("ignoreNullFields", False).json(new)
    except Exception:
        removed(df.sparkSession, new)
        raise
    return new


def swap(spark: SparkSession, new: dict[str, str]) -> None:
    """Puts each new folder in its path's place; a rename that fails restores every old one and raises.

    The old folders are deleted last. A store without atomic swaps leaves a path absent between two renames.
    """
    of = spark._jvm.org.apache.hadoop.fs.Path
    done: list[tuple] = []

    def rename(fs, a: str, b: str) -> None:
        if not fs.rename(of(a), of(b)):
            raise OSError(f"{a} could not be renamed to {b}")

    try:
        for path, fresh in new.items():
            fs, old = of(path).getFileSystem(spark._jsc.hadoopConfiguration()), None
            if fs.exists(of(path)):
                old = f"{path}.old-{uuid.uuid4().hex[:8]}"
                rename(fs, path, old)
            done.append((fs, path, old))
            rename(fs, fresh, path)
    except Exception:
        for fs, path, old in reversed(done):
            if old is not None:
                fs.delete(of(path), True)
                fs.rename(of(old), of(path))
        raise
    for fs, _, old in done:
        if old is not None:
            fs.delete(of(old), True)


def write_json(df: DataFrame, path: str) -> None:
    """Writes JSON lines beside ``path`` and swaps them in once they are committed."""
    swap(df.sparkSession, {path: written_beside(df, path)})


def refresh(frames: dict[str, DataFrame], least_rows: int = 1, provenance: str | None = None, notes: dict[str, dict] | None = None) -> dict[str, int]:
    """Writes every frame to its path, or none, and returns their rows.

    All frames are written beside their paths first, each computed once; only when all passed the gate are they swapped
    in. ``provenance`` is then written: a JSON record of path, rows and what ``notes`` has on each path.
    """
    new, counts = {}, {}
    spark = next(iter(frames.values())).sparkSession
    try:
        for path, df in frames.items():
            new[path] = written_beside(df, path)
            counts[path] = spark.read.text(new[path]).count()
        short = [p for p, n in counts.items() if n < least_rows]
        if short:
            raise ValueError(f"too few records for {', '.join(short)}")
    except Exception:
        for fresh in new.values():
            removed(spark, fresh)
        raise
    swap(spark, new)
    if provenance:
        rows = [(p, n, json.dumps((notes or {}).get(p, {}), sort_keys=True)) for p, n in counts.items()]
        write_json(spark.createDataFrame(rows, "path string, records long, notes string").withColumn("retrieved", F.date_format(F.current_timestamp(), "yyyy-MM-dd")), provenance)
    return counts
