"""Small documents with the awkward cases: nulls, empty texts, ties, repeats, long texts, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = [(k, prose(rng, rng.randint(20, 120)), "en", rng.choice(["a", "b", None]), 0) for k in range(n)]
    return out + [(n, "", "en", "a", 0), (n + 1, None, None, None, None), (n + 2, "   \n\t", "en", "b", 0), (None, "no id here at all", "en", "a", 0), (3, out[3][1], "en", "a", 0), (n + 3, prose(rng, 30_000), "en", "b", 0), (n + 4, out[5][1], "de", "b", 0)]


def documents(spark, data=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    clash = ("fp", "node", "root", "score", "label", "size", "key", "part", "id", "x", "_doc", "position", "unit")
    return df.repartition(3).withColumns({c: F.lit(7) for c in clash})


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
