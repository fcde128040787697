"""Text features as column expressions; only the character entropy needs Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What a link starts with, and the order of the model's inputs.
LINK_PREFIXES = ("http://", "https://", "www.")
MODEL_INPUTS = ("ln_word_count", "ln_link_count", "link_ratio", "uppercase_ratio", "lexical_diversity", "char_entropy", "avg_word_length")

#: The columns that ``with_features`` adds.
FEATURES = ("word_count", "link_count", "link_ratio", "uppercase_ratio", "lexical_diversity", "avg_word_length", "char_entropy")


def tokens(text: Column) -> Column:
    """Runs between Unicode white space; none of a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def link_count(words: Column) -> Column:
    starts = lambda t: F.startswith(t, F.lit(LINK_PREFIXES[0])) | F.startswith(t, F.lit(LINK_PREFIXES[1])) | F.startswith(t, F.lit(LINK_PREFIXES[2]))
    return F.size(F.filter(words, starts)).cast("long")


def uppercase_ratio(text: Column) -> Column:
    """Upper-case letters over letters of the whole text."""
    of = lambda kind: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"\P{{{kind}}}", ""))
    return of("IsUppercase") / F.greatest(F.lit(1), of("IsAlphabetic"))


def in_slices(texts: pa.Array, of: Callable[[list], np.ndarray], rows: int = 256) -> pa.Array:
    """``of`` over an Arrow batch, of which only ``rows`` texts at a time become Python's own strings."""
    return pa.array(np.concatenate([of(texts.slice(at, rows).to_pylist()) for at in range(0, max(1, len(texts)), rows)]))


BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def entropy(text: str | None) -> float:
    """``char_entropy`` of one text, whose characters are counted in pieces."""
    count = np.zeros(0, np.int64)
    for at in range(0, len(text or ""), 1 << 18):
        own = np.bincount(np.frombuffer(text[at : at + (1 << 18)].encode("utf-32-le", "surrogatepass"), np.uint32))
        few, many = sorted((count, own), key=len)
        many[: len(few)] += few
        count = many
    count[BLANKS[BLANKS < len(count)]] = 0
    count = count[count > 0]
    n = count.sum()
    return float(np.log2(n) - (count * np.log2(count)).sum() / n) if n else 0.0


@F.arrow_udf(DoubleType())
def char_entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy in bits of the characters that aren't white space; 0 of an empty text.

    Row-local, so it neither explodes texts to characters nor shuffles, and runs on streams as well.
    """
    return in_slices(texts, lambda some: np.array([entropy(t) for t in some], np.float64))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with word_count, link_count, link_ratio, uppercase_ratio, lexical_diversity, avg_word_length, char_entropy.

    Ratios divide by at least 1, so all features of an empty text are 0, the diversity too.
    """
    df = df.withColumn("_words", tokens(F.col(text)))
    words, n = F.col("_words"), F.size("_words").cast("long")
    some = F.greatest(F.lit(1), n)
    letters = F.length(F.array_join(words, ""))
    out = df.withColumns({
        "word_count": n, "link_count": link_count(words), "uppercase_ratio": uppercase_ratio(F.col(text)),
        "lexical_diversity": F.size(F.array_distinct(F.transform(words, F.lower))) / some, "avg_word_length": letters / some, "char_entropy": char_entropy(F.col(text)),
    })
    return out.withColumn("link_ratio", F.col("link_count") / F.greatest(F.lit(1), "word_count")).drop("_words")


def email_domain(email: Column) -> Column:
    """The lower-case part after the last @, null unless both sides are non-empty and it holds a dot and no @."""
    last = F.substring_index(email, "@", -1)
    before = F.length(email) - F.length(last) - 1
    domain = F.lower(F.regexp_replace(last, r"(?U)^\s+|\s+$", ""))
    return F.when(F.contains(email, F.lit("@")) & (F.length(last) > 0) & (before > 0) & F.contains(domain, F.lit(".")), domain)


def model_inputs() -> Column:
    """The model's seven inputs in order, from the columns of ``with_features``."""
    return F.array(F.log1p("word_count"), F.log1p("link_count"), *(F.col(c).cast("double") for c in MODEL_INPUTS[2:]))


def text_group(text: Column) -> Column:
    """SHA-256 of the lower-case words joined by single spaces: equal for texts that differ in case and spacing."""
    return F.sha2(F.array_join(F.transform(tokens(text), F.lower), " "), 256)


def split_of(group: Column) -> Column:
    """train (70 of 100), validation (15) or test (15), by the first 32 bits of a text group."""
    bucket = F.conv(F.substring(group, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")
