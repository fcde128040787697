"""Quality classifier (operator 10): Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

import string
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import map_arrow, spread, table, written
from siftwell.llm.labelled import best_cut, fit_labels, held_out, logistic, sigmoid

#: Preference pairs that the ranking is fitted on at most, drawn with a fixed seed from the fitted rows' good and bad ones.
PAIRS = 100_000
CUT = 0.7
UPPER, LOWER, DIGIT = (np.frombuffer(x.encode(), np.uint8) for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
MARKS = np.frombuffer(b".,;:!?|*#%$&@^~=+<>_/\\-\"'()[]{}", np.uint8)
WIDTH = 19


def features(text: str | None) -> np.ndarray:
    """WIDTH numbers that describe a whole text: lengths, repetition, case and punctuation; of an empty text, zeros."""
    words = (text or "").split()
    if not words:
        return np.zeros(WIDTH)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256)
    n, size = len(words), len(raw)
    upper, lower, marks = count[UPPER].sum(), count[LOWER].sum(), count[MARKS]
    lines = text.split("\n")
    stops = marks[0] + marks[5]
    shares = [
        len(set(words)) / n ** 0.9,
        sum(map(eq, words, words[1:])) / n,
        upper / max(1, upper + lower),
        count[DIGIT].sum() / size,
        marks[6] / n,
        marks[4] / n,
        marks[7:12].sum() / n,
        marks[12:].sum() / n,
        marks[1:4].sum() / n,
        stops / n,
        len(set(lines)) / len(lines),
        (count[128:].sum()) / size,
    ]
    long = [np.log1p(n), np.log1p(size / n), np.log1p(n / len(lines)), np.log1p(n / (stops + 1))]
    spikes = [np.log(1e-3 + shares[k]) for k in (1, 2, 6)]
    return np.array(shares + long + spikes)


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row of ``docs``."""
    return map_arrow(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "x": [features(t) for t in c["text"]]}, "doc_id long, x array<double>")


def basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares' excess, so that either tail may count against a text."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, np.abs(z), np.maximum(0, z - 1), np.maximum(0, -z - 1)], axis=1)


class Ranking:
    """A fitted ranking: ``score`` is a probability-like number, CUT at the chosen quantile of the fitted scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        z = basis(x, self.mean, self.scale) if len(x) else np.zeros((0, 4 * WIDTH))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.w, self.cut, self.slope = np.zeros(4 * WIDTH), 0.0, 1.0
        if len(good) and len(bad):
            a, b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
            self.w = logistic(z[a] - z[b], np.ones(PAIRS), l2=1e-3)
            s = z @ self.w
            self.cut = best_cut(s, y)
            self.slope = float(np.clip(logistic(((s - self.cut) / (s.std() + 1e-9))[:, None], y, l2=1e-4)[0] / (s.std() + 1e-9), 1e-3, 1e3))

    def score(self, x: np.ndarray) -> np.ndarray:
        s = basis(x, self.mean, self.scale) @ self.w
        return sigmoid(np.log(CUT / (1 - CUT)) + self.slope * (s - self.cut))


def fitted(kept: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> Ranking:
    """A ranking fitted on the labelled rows of ``kept`` (doc_id, x), a bounded number."""
    fit = fit_labels(labels, "quality", modulus, remainder)
    rows = kept.join(F.broadcast(fit), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("label").alias("label")).orderBy("doc_id").collect()
    return Ranking(np.array([r[1] for r in rows]).reshape(-1, WIDTH), np.array([r[2] for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are ignored).

    The ranking is fitted on at most FIT_ROWS labelled rows that are not held out and at most PAIRS preference
    pairs of them: the logistic loss of feature differences between a good and a bad document. The score rises
    with the rank; predicted is 1 from 0.7, which lies at the score quantile that separates the fitted rows best.
    Null and empty texts have all features zero and are scored like any other; repeated rows are scored alike;
    without labels of both classes every score is 0.7. Scores use the text only.
    """
    kept = written(with_features(docs), "features")
    model = fitted(kept, labels, modulus, remainder)

    def scored(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "score": model.score(np.array(c["x"]).reshape(-1, WIDTH))}

    return map_arrow(kept, scored, "doc_id long, score double").select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``docs`` without the rows predicted 0; all columns pass through and no text is shuffled."""
    own = fit_labels(labels, "quality", modulus, remainder).select("doc_id")
    model = fitted(with_features(docs.join(F.broadcast(own), "doc_id", "left_semi")), labels, modulus, remainder)

    def good(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            score = model.score(np.array([features(t) for t in texts]).reshape(-1, WIDTH))
            yield batch.filter(pa.array(score >= CUT))

    return docs.mapInArrow(good, docs.schema)
