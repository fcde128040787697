"""Toxicity (operator 9): maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import map_arrow, spread, table, written
from siftwell.llm.labelled import fit_labels, held_out, logistic, sigmoid

#: Units (words and word beginnings) of the model at most, those of largest |z|.
UNITS = 50_000
#: Spellings whose score a worker keeps at most.
CACHE = 400_000
#: Letters of the word beginnings that stand in for words too rare to have log-odds of their own.
STEMS = (6, 5)
#: Fitted documents (copies weighed down) that a unit must occur in, its least likelihood ratio (2 ln), its least
#: |log-odds|, and the prior's weight in documents.
LEAST, LEAST_G, LEAST_ODDS, PRIOR = 3.0, 15.0, 0.7, 20.0
#: Minimum hashes by which copies among the fitted documents are weighed down.
SKETCH = 8
#: What each word costs a segment, so that segments of ordinary words sum to less than nothing.
DRIFT = 0.08
PUNCTUATION = ".,;:!?|*#%$&@^~=+<>_/\\-\"'()[]{}«»„“”‘’¿¡…–—`"


def units(spelling: str) -> list[str]:
    """The word and its beginnings, longest first; none for bare punctuation."""
    w = spelling.lower().strip(PUNCTUATION)
    return [w, *(f"{w[:k]}~" for k in STEMS if len(w) >= k)] if w else []


class Scores(dict):
    """Spelling → score of a word: the log-odds of its longest known unit, less DRIFT."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, spelling: str) -> float:
        s = next((self.odds[u] for u in units(spelling) if u in self.odds), 0.0) - DRIFT
        if len(self) < CACHE:
            self[spelling] = s
        return s


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) of a sequence, in linear time (Ruzzo and Tompa, 1999).

    Each open segment keeps the place of the last one before it whose left sum is smaller; the search for a new one's
    place jumps along these, and no jump is made twice.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    firsts, ends, lows, highs, before = [], [], [], [], []
    for i, low, high in zip((at := np.flatnonzero(score > 0)).tolist(), total[at].tolist(), total[at + 1].tolist()):
        first, j = i, len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = before[j]
            if j < 0 or highs[j] >= high:
                break
            first, low, up = firsts[j], lows[j], before[j]
            del firsts[j:], ends[j:], lows[j:], highs[j:], before[j:]
            j = up
        firsts.append(first), ends.append(i + 1), lows.append(low), highs.append(high), before.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(firsts, ends, lows, highs)]


def scored_words(scores: Scores, text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a whole text and the score of every one."""
    words = (text or "").split()
    return words, np.fromiter(map(scores.__getitem__, words), float, len(words))


def damped(words: list[str], s: np.ndarray, first: int, end: int) -> float:
    """A segment's sum in which the n-th occurrence of a spelling within it counts 1/n, at most the whole.

    Each repeat still raises it; a word said a hundred times counts as about five.
    """
    seen: Counter = Counter()
    total = 0.0
    for word, x in zip(words[first:end], s[first:end].tolist()):
        if x > 0:
            seen[word] += 1
            total += x / seen[word]
        else:
            total += x
    return max(total, float(s[first:end].max()))


class Model:
    """Log-odds of units, the Gumbel law of a clean text's best segment, and the calibration of scores."""

    def __init__(self, counts: list[tuple], toxic: float, clean: float):
        n = np.array([c[1:] for c in counts], float).reshape(-1, 2)
        odds = gain = np.zeros(0)
        if toxic and clean and len(n):
            every = np.array([toxic, clean], float)
            prior = PRIOR * n.sum(1, keepdims=True) / every.sum()  # Dirichlet, in proportion to the units' frequency
            hit = n + prior
            odds = np.log(hit / np.maximum(1e-9, every + PRIOR - hit)) @ np.array([1.0, -1.0])
            table = np.stack([n, np.maximum(1e-9, every - n)], axis=2)
            expected = table.sum(1, keepdims=True) * table.sum(2, keepdims=True) / every.sum()
            gain = 2 * (table * np.log(np.maximum(table, 1e-12) / np.maximum(expected, 1e-12))).sum((1, 2))
        order = [k for k in np.argsort(-gain, kind="stable") if gain[k] >= LEAST_G and abs(odds[k]) >= LEAST_ODDS][:UNITS]
        self.odds = {counts[k][0]: float(odds[k]) for k in order}
        self.rate, self.shift, self.w = 1.0, 0.0, np.array([-2.0, 0.5, 0.0])

    def evidence(self, scores: Scores, text: str | None) -> tuple[float, float, int]:
        """(best damped sum of a segment, damped sum of all segments' toxic words, words) of a whole text."""
        words, s = scored_words(scores, text)
        found = segments(s)
        # Repeats are damped over the whole text in the sum of all segments, within the segment in the best one's.
        seen: Counter = Counter()
        for a, b, _ in found:
            seen.update(words[k] for k in range(a, b) if s[k] > 0)
        total = sum(scores[w] * (1 + np.log(n)) for w, n in seen.items())
        return max((x[2] if x[1] - x[0] == 1 else damped(words, s, x[0], x[1]) for x in found), default=0.0), float(total), len(s)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """(1, surprise of the best segment, of all segments): -ln P under the Gumbel law, which grows with ln(words)."""
        above = self.rate * x[:, 0] - self.shift - np.log(np.maximum(1, x[:, 2]))
        surprise = -np.log(np.maximum(1e-300, -np.expm1(-np.exp(-np.clip(above, -30, 600)))))
        return np.stack([np.ones(len(x)), np.minimum(surprise, 30), np.log1p(np.maximum(0, x[:, 1]) / np.log(2 + x[:, 2]))], axis=1)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fits the Gumbel law by moments on the clean documents, then the probability of the label."""
        clean = x[y == 0]
        if len(clean) > 20 and (y == 1).any():
            spread = clean[:, 0].std()
            self.rate = float(np.pi / np.sqrt(6) / max(spread, 0.2))
            self.shift = float(np.mean(self.rate * clean[:, 0] - np.log(np.maximum(1, clean[:, 2]))) - np.euler_gamma)
            self.w = logistic(self.inputs(x), y, l2=1e-4)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.w)


def sketch(text: str | None) -> list[int]:
    """SKETCH minimum hashes of a text's three-word shingles."""
    words = (text or "").split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
    return [int(((h * np.uint64(2 * k + 3)) ^ (h >> np.uint64(7 * k + 1))).min() >> np.uint64(1)) for k in range(SKETCH)]


def weights(rows: DataFrame) -> dict:
    """doc_id → weight of each fitted document: one over the mean number that share one of its minimum hashes."""
    found = map_arrow(rows.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "mins": [sketch(t) for t in c["text"]]}, "doc_id long, mins array<long>").collect()
    if not found:
        return {}
    mins = np.array([r[1] for r in found])
    shared = np.zeros(len(mins))
    for k in range(SKETCH):
        _, at, n = np.unique(mins[:, k], return_inverse=True, return_counts=True)
        shared += n[at]
    return dict(zip((r[0] for r in found), (SKETCH / shared).tolist()))


def counted(rows: DataFrame, weight: dict) -> DataFrame:
    """(unit, toxic, clean): summed weights of the fitted documents of each class that hold a unit, from LEAST on."""
    sent = rows.sparkSession.sparkContext.broadcast(weight)

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([float(seen[y][k]) for k in keys], pa.float64()) for y in (1, 0))], ["unit", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()
            return made

        for batch in batches:
            for doc, text, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                w = sent.value[doc]
                for u in {u for x in set((text or "").split()) for u in units(x)}:
                    seen[label][u] += w
                if len(seen[0]) + len(seen[1]) > CACHE:
                    yield out()
        yield out()

    parts = rows.select("doc_id", "text", "label").mapInArrow(count, "unit string, toxic double, clean double")
    return parts.groupBy("unit").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("toxic", "clean"))).where(F.col("toxic") + F.col("clean") >= LEAST)


def fitted(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> Model:
    """A model of at most FIT_ROWS labelled rows that are not held out; at most 4 * UNITS counts reach the driver."""
    fit = fit_labels(labels, "toxic", modulus, remainder)
    rows = docs.select("doc_id", "text").join(F.broadcast(fit), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = written(rows, "labelled")
    weight = weights(rows)
    n = {0: 0.0, 1: 0.0}
    for doc, label in rows.select("doc_id", "label").collect():
        n[label] += weight[doc]
    odd = F.abs(F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - float(np.log((n[1] + 1) / (n[0] + 1))))
    most = counted(rows, weight).orderBy(F.desc(odd * F.sqrt(F.col("toxic") + F.col("clean"))), "unit").limit(4 * UNITS)
    model = Model([tuple(r) for r in most.collect()], n[1], n[0])
    x = measured(rows.select("doc_id", "text"), model).join(rows.select("doc_id", "label"), "doc_id").orderBy("doc_id").select("best", "total", "words", "label").collect()
    x = np.array([tuple(r) for r in x], float).reshape(-1, 4)
    model.calibrate(x[:, :3], x[:, 3])
    return model


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, best, total, words) of each row of ``docs``."""

    def run(batches):
        scores = Scores(model.odds)
        for batch in batches:
            found = [model.evidence(scores, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(f[k]) for f in found], pa.float64()) for k in range(3))], ["doc_id", "best", "total", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, best double, total double, words double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Each word scores its log-odds between toxic and clean fitted documents; every maximal scoring segment of the
    whole text is found by uncapped scores and in linear time, however long the text. For the score repeats are
    damped: the n-th occurrence of a spelling in a segment adds 1/n of its score. The best segment's sum becomes a
    p-value of the Gumbel law that clean documents follow, and a logistic curve over that and the sum of all segments
    gives the score. Null and empty texts hold no segment and get the base score; repeated rows are scored alike;
    of equal segments the first counts; without labels of both classes every score is the base score; an empty table
    gives no rows. The model is fitted on at most FIT_ROWS labelled rows that are not held out.
    """
    model = fitted(docs, labels, modulus, remainder)

    def scored(c: dict) -> dict:
        x = np.array([c["best"], c["total"], c["words"]], float).T.reshape(-1, 3)
        return {"doc_id": c["doc_id"], "score": model.score(x)}

    out = map_arrow(measured(docs, model), scored, "doc_id long, score double")
    return out.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_passages(docs: DataFrame, model: Model, p: float = 1e-3) -> DataFrame:
    """(doc_id, first_word, end_word, score, p_value): every segment whose p-value is at most ``p``.

    score is the segment's sum, p_value that of its damped sum. A passage that a text repeats is found each time.
    """

    def run(batches):
        scores = Scores(model.odds)
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, by_word = scored_words(scores, text)
                for a, b, s in segments(by_word):
                    above = model.rate * damped(words, by_word, a, b) - model.shift - np.log(max(1, len(words)))
                    chance = float(-np.expm1(-np.exp(-np.clip(above, -30, 600))))
                    if chance <= p:
                        rows.append((d, a, b, s, chance))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "first_word", "end_word", "score", "p_value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, first_word long, end_word long, score double, p_value double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
