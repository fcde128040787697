"""Reputation stores as Parquet tables in a folder: opened, seeded and updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.scoring import Stores
from siftwell.sources.readers import ip_ranges
from siftwell.sources.sinks import swap

TABLES = {"disposable": "domain string", "ips": "key string, score double", "domains": "domain string, score double", "fingerprints": "fp long, score double", "network": "fp long, score double"}


def disposable_seeds(lines: DataFrame) -> DataFrame:
    """(domain) of lines (value), trimmed; blank lines and comments are left out. Names are kept as they stand."""
    own = lines.select(F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("domain"))
    return own.where("domain <> '' AND NOT startswith(domain, '#')").distinct()


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder, empty where the folder has none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}") if found else spark.createDataFrame([], TABLES[name])


def upserted(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> None:
    """Puts ``rows`` into a table by its key: new keys are added, known ones take the new score, the rest stays.

    The whole table is written beside the old one and swapped in; rows of one key take the largest score.
    """
    key, *rest = [c.split()[0] for c in TABLES[name].split(", ")]
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).alias(c) for c in rest)) if rest else rows.where(F.col(key).isNotNull()).select(key).distinct()
    both = stored(spark, folder, name).join(new.select(key), key, "left_anti").unionByName(new)
    fresh = f"{folder}/{name}.next"
    both.write.mode("overwrite").parquet(fresh)
    swap(spark, {f"{folder}/{name}": fresh})


def open_stores(spark: SparkSession, folder: str, disposable_lines: DataFrame | None = None, ip_lines: DataFrame | None = None, **options) -> Stores:
    """The stores of a folder. Seeds (lines in a column value) are put in at every opening; doing so again changes nothing.

    ``options`` go to Stores: kind, secret, suffixes, exact_first; with a secret the network's table counts too.
    """
    if disposable_lines is not None:
        upserted(spark, folder, "disposable", disposable_seeds(disposable_lines))
    if ip_lines is not None:
        upserted(spark, folder, "ips", ip_ranges(ip_lines))
    network = stored(spark, folder, "network") if options.get("secret") else None
    return Stores(*(stored(spark, folder, n) for n in ("disposable", "ips", "domains", "fingerprints")), network=network, **options)
