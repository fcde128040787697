"""Mixing sources to target weights (operator 7), with DataFrame functions only.

A curriculum gives each source a weight over training time; its integral is the source's cumulative demand for
words. A document's place in its source's own order is a stretch of that demand, whose inverse is the document's
training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import checkpointed, table, written

#: Documents of a part of a source's order, so that no task needs a whole source.
PART_ROWS = 4_000
#: Pieces of time in which the sources' weights change.
PIECES = 8
#: Times that a source's words may be taken at most.
REPEATS = 3.0


def word_count(text: Column) -> Column:
    """Words between ASCII white space: a word starts where a character follows white space or the beginning."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(blank, " "), "")).cast("long"), F.lit(0).cast("long"))


def source_key() -> Column:
    """Sources by code point, null last and apart from every name."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def targets(sizes: DataFrame, curriculum: DataFrame, repeats: float = REPEATS) -> DataFrame:
    """(key, source_size, target, steps) of each source.

    ``sizes`` has (key, source_size), ``curriculum`` (key, begins, ends, weight): a piecewise constant weight
    over training time from 0 to 1. At any time the sources share the words by weight; a target stops at
    ``repeats`` times its source's size and the rest is reshared by the sources' whole demand until none is
    above. ``steps`` holds the source's cumulative demand at the ends of the curriculum's pieces.
    """
    whole = Window.partitionBy("begins", "ends")
    shared = curriculum.join(sizes, "key").withColumn("area", F.col("weight") / F.sum("weight").over(whole) * (F.col("ends") - F.col("begins")))
    by_key = shared.groupBy("key").agg(F.first("source_size").alias("source_size"), F.sum("area").alias("share"), F.sort_array(F.collect_list(F.struct("begins", "ends", "area"))).alias("pieces"))
    by_key = checkpointed(by_key)
    cap = F.col("source_size") * F.lit(float(repeats))
    total = by_key.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level rises until no source is above its cap; each round caps at least one more
        below = F.col("share") * F.lit(level) < cap if level else F.lit(True)
        capped, share = by_key.agg(F.sum(F.when(~below, cap).otherwise(0.0)), F.sum(F.when(below, F.col("share")).otherwise(0.0))).first()
        if not share:
            break
        now = (total - capped) / share
        if now <= level * (1 + 1e-12):
            break
        level = now
    target = F.least(F.col("share") * F.lit(float(level)), cap)
    before = F.lit(0.0)
    steps = F.aggregate(
        "pieces",
        F.struct(before.alias("at"), F.expr("cast(array() as array<struct<low:double,high:double,begins:double,ends:double>>)").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["area"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("low"), (acc["at"] + x["area"]).alias("high"), x["begins"].alias("begins"), x["ends"].alias("ends")))).alias("out")),
        lambda acc: acc["out"],
    )
    return by_key.select("key", "source_size", F.when(F.col("share") > 0, target).otherwise(0.0).alias("target"), "share", steps.alias("steps"))


def position(offset: Column) -> Column:
    """The training time at which a source's demand reaches ``offset`` words, by inverting its cumulative demand."""
    x = offset / F.col("target") * F.col("share")
    piece = F.try_element_at(F.filter("steps", lambda s: (s["high"] > s["low"]) & (x <= s["high"] * F.lit(1 + 1e-12))), F.lit(1))
    last = F.try_element_at(F.col("steps"), F.lit(-1))
    found = piece["begins"] + (x - piece["low"]) / (piece["high"] - piece["low"]) * (piece["ends"] - piece["begins"])
    return F.when(F.col("target") > 0, F.coalesce(found, last["ends"]))


def row_hash(seed: int) -> Column:
    """A seeded hash by which a source's documents are put in order: of the id, or of the text where there is none."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))


def mix(docs: DataFrame, curriculum=None, repeats: float = REPEATS, seed: int = 7, named: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, position) of each row of ``docs``, and name where ``named``.

    size is the number of words of the whole text (null: 0). ``curriculum`` is a DataFrame (key, begins, ends,
    weight), or a function from the sources' (key, source_size) to one; None weighs all sources alike. A source
    of target T and size S is taken T // S times whole, and the first T mod S words of its order once more: taken
    counts words, repeats included, and the order is by a seeded hash of doc_id, so reruns agree. copies are the
    passes that take a document whole or at least half. position is the time from 0 to 1 at which its first
    pass begins, the inverse of the source's integrated demand. A null source is a source of its own; null and empty
    texts take nothing; a row without an id has its place by its text; ties of the hash go by id and size; repeated rows
    take their own stretches; texts may be of any length; an empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    h, name = row_hash(seed), F.lit(None).cast("string") if named is None else named
    thin = written(docs.select("doc_id", "source", source_key().alias("key"), word_count(F.col("text")).alias("size"), h.alias("h"), name.alias("name")), "sizes")
    thin = thin.withColumn("part", F.pmod("h", F.lit(max(1, thin.count() // PART_ROWS))).cast("int"))
    parts = checkpointed(thin.groupBy("key", "part").agg(F.sum("size").alias("words")))
    sizes = checkpointed(parts.groupBy("key").agg(F.sum("words").alias("source_size")))
    if curriculum is None:
        curriculum = sizes.select("key", F.lit(0.0).alias("begins"), F.lit(1.0).alias("ends"), F.lit(1.0).alias("weight"))
    elif callable(curriculum):
        curriculum = curriculum(sizes)
    to = targets(sizes, curriculum, repeats)
    starts = parts.withColumn("ahead", F.sum("words").over(Window.partitionBy("key").orderBy("part")) - F.col("words")).drop("words")
    order = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = thin.withColumn("upto", F.sum("size").over(order)).join(starts, ["key", "part"]).withColumn("at", F.col("ahead") + F.col("upto") - F.col("size"))
    dealt = placed.join(to, "key", "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("at")))
    return dealt.select(
        "doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce(F.col("size") * whole + part, F.lit(0).cast("long")).alias("taken"),
        F.coalesce(whole + F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), 1).otherwise(0), F.lit(0)).cast("int").alias("copies"), position(F.col("at")).alias("position"),
        "share", "steps", "at", "name",
    )


def cycling_weights(sizes: DataFrame) -> DataFrame:
    """Weights that change over PIECES of time and integrate to 1, 2, 3, repeating, for the sources in order of their keys.

    Early on the first sources weigh more than that and the last ones less, later the other way round, in equal steps. Each
    source's swing is its rank's distance from the weighted mean rank, so the weights of all sources add up to the
    same at any time and each source's share of the words is that of its integral. One row for each source is ranked in
    one task.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.select("key", F.row_number().over(Window.orderBy("key")).alias("rank"))
    ranked = ranked.withColumn("mean_weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    place = (F.col("rank") - 1) / F.greatest(F.lit(1), F.max("rank").over(every) - 1)
    swung = ranked.withColumn("place", place).withColumn("swing", F.sum(F.col("place") * F.col("mean_weight")).over(every) / F.sum("mean_weight").over(every) - F.col("place"))
    pieces = swung.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    weight = F.col("mean_weight") * (1 + F.col("swing") * ((PIECES - 1) / PIECES - 2 * F.col("piece") / PIECES))
    return pieces.select("key", (F.col("piece") / PIECES).alias("begins"), ((F.col("piece") + 1) / PIECES).alias("ends"), weight.alias("weight"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, then copies and position, of every document, range-sorted by position."""
    found = mix(table(spark, sf_dir, "documents"), cycling_weights).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return found.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def arranged(docs: DataFrame, curriculum=cycling_weights, repeats: float = REPEATS) -> DataFrame:
    """``docs`` as the mixture takes them: each row once for each of its copies, range-sorted by training position.

    Documents that no pass takes at least half of are left out. Rows are known by id, source and text, so those without an
    id or with a repeated one are taken like any other; of rows that repeat all three, one stands for all their copies.
    Null and empty texts take no words and are left out; an empty table gives no rows; other columns pass through.
    """
    told = F.sha2(F.to_json(F.struct("doc_id", "source", "text")), 256)
    picked = mix(docs, curriculum, repeats, named=told).where("copies > 0")
    passes = picked.select("name", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"), "at", "target", "share", "steps", "source_size")
    timed = written(passes.select(F.col("name").alias("__mix_name"), position(F.col("at") + F.col("pass") * F.col("source_size")).alias("__mix_position"), F.col("pass").alias("__mix_pass")), "passes")
    known = docs.withColumn("__mix_own", told)
    if not timed.groupBy("__mix_name", "__mix_pass").count().where("count > 1").isEmpty():
        known = known.dropDuplicates(["__mix_own"])
    joined = known.join(timed, F.col("__mix_own") == F.col("__mix_name"))
    return joined.repartitionByRange("__mix_position", "__mix_name").sortWithinPartitions("__mix_position", "__mix_name", "__mix_pass").select(docs.columns)
