"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that operators hand on at most; long texts make batches large.
BATCH_ROWS = 1024
#: Bits of a bitmap of ``possible`` at most (4 MB), bits for each key as far as that goes, and bits of one of its rows.
MARK_BITS, MARK_SHARE, MARK_ROW = 1 << 25, 16, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table over all cores if it is read in fewer than 16 tasks, as one row group of one file is.

    Such a table is small, so that moving its rows costs less than working on them in one task; larger ones stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(16, cores) else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the setting is absent, a local master gets a temporary folder; a cluster is refused, since a
    machine-local folder would be invisible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_siftwell_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark._siftwell_dir = base
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{base}/rdd")
    return f"{base}/{what}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes a query's shuffle files as it ends instead of when their objects are collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    with shuffle_files_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` with the folder set where the session has none; its shuffle files go as it ends."""
    shared_dir(df.sparkSession, "unused")
    with shuffle_files_removed(df.sparkSession):
        return df.checkpoint()


def map_arrow(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """``rows`` from columns as lists to columns as lists, applied to slices of at most BATCH_ROWS rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = rows(batch.slice(at, BATCH_ROWS).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """A fixed sample of ``df``: the ``n`` rows whose ``key`` has the smallest hash, and at most so many.

    A threshold taken from the number of rows leaves about 1.2 n of them before the sort, so what meets in one task
    depends on n, not on the table.
    """
    rows, h = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 32))
    share = 1.2 * (n + 100) / max(1, rows)
    return (df.where(h < int(share * (1 << 32))) if share < 1 else df).orderBy(h, key).limit(n)


def possible(rows: DataFrame, key: list[Column], wanted: DataFrame, wanted_key: list[Column], name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``, false only where no row of ``wanted`` has the key (nulls are equal).

    Wide rows that a join would only drop or pass through then need no shuffle. Hashes of the keys are marked in a bitmap of
    bounded size that goes out to all tasks; the more keys share it, the more rows are possible in vain, none is lost.
    """
    size = min(MARK_BITS, max(MARK_ROW, 1 << (MARK_SHARE * wanted.count()).bit_length()))
    slot = lambda of: F.pmod(F.xxhash64(*of), F.lit(size))
    marks = wanted.select((slot(wanted_key) / MARK_ROW).cast("long").alias("__mark_row"), F.pmod(slot(wanted_key), F.lit(MARK_ROW)).alias("__mark_at"))
    bits = checkpointed(marks.repartition("__mark_row").groupBy("__mark_row").agg(F.bitmap_construct_agg("__mark_at").alias("__mark_bits")))
    at = rows.withColumn("__mark_slot", slot(key)).withColumn("__mark_row", (F.col("__mark_slot") / MARK_ROW).cast("long")).withColumn("__mark_at", F.pmod("__mark_slot", F.lit(MARK_ROW)))
    byte = "cast(conv(hex(substring(__mark_bits, cast(__mark_at div 8 as int) + 1, 1)), 16, 10) as int)"
    found = at.join(F.broadcast(bits), "__mark_row", "left").withColumn(name, F.expr(f"coalesce((shiftright({byte}, cast(__mark_at % 8 as int)) & 1) = 1, false)"))
    return found.select(*rows.columns, name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Forest:
    """Union-find over 0..n-1 that takes arrays of pairs and keeps the smallest member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b bigint) as (node, root), root the smallest node.

    Alternates large-star and small-star contraction (Kiveris et al., 2014). Every round is a join and an
    aggregation on node ids whose skewed keys adaptive execution can split; edges stay distributed and a
    reliable checkpoint cuts the lineage of each round.
    """
    e = checkpointed(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components_marked(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``nodes`` with a column ``root``: the component's smallest node, the node itself where it has no edge."""
    found = components(edges).withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn("root", F.coalesce("root", node))


def bucket_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _h, _n) as a written table: the rows at home and all rows of each key with pairs to look at."""
    sizes = rows.groupBy(*keys).agg(F.sum(F.col("home").cast("long")).alias("_h"), F.count("*").alias("_n"))
    return written(sizes.where("_h > 0 AND _n > 1"), "sizes")


def blocks(n: str, cap: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / cap).cast("int"))


def dealt_rows(sizes: DataFrame, cap: int) -> int:
    """The rows that ``grid`` makes of buckets of these sizes."""
    return int(sizes.agg(F.sum(F.col("_h") * blocks("_n", cap) + F.col("_n") * blocks("_h", cap))).first()[0] or 0)


def grid(rows: DataFrame, keys: list[str], cap: int, sizes: DataFrame) -> DataFrame:
    """Deals ``rows`` (with booleans ``home``) of each key of ``sizes`` into blocks of about ``cap`` rows.

    Adds ``hb`` and ``mb``, the home block and member block of a task: home rows meet every member block,
    all rows are members and meet every home block. Groups of the result by keys, hb and mb hold about
    two caps of rows however large a key is, and no pair of a home row and another row is lost. Rows carry
    ``as_home`` to tell in which role they come. The random deal is by a hash of ``id``. A row is read once and
    dealt in both roles at once.
    """
    dealt = rows.join(sizes.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys]))
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks(n, cap)).cast("int")
    place = lambda hb, mb, home: F.struct(hb.alias("hb"), mb.alias("mb"), F.lit(home).alias("as_home"))
    as_home = F.transform(F.sequence(F.lit(0), blocks("_n", cap) - 1), lambda mb: place(own("_h", 1), mb, True))
    as_member = F.transform(F.sequence(F.lit(0), blocks("_h", cap) - 1), lambda hb: place(hb, own("_n", 2), False))
    roles = F.when(F.col("home"), F.concat(as_home, as_member)).otherwise(as_member)
    return dealt.select(*rows.columns, F.inline(roles))
