import random
import time
import zlib

from siftwell.llm import quality, toxicity
from siftwell.llm.common import table
from siftwell.llm.labelled import best_cut, fit_labels, logistic
from tests.llm.helpers import documents, empty, prose, rows

import numpy as np

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        bad, toxic = k % 5 == 0, k % 4 == 1
        text = prose(rng, rng.randint(30, 90))
        words = text.split()
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "scumbag", "rotten"]))
        text = " ".join(words)
        if bad:
            text = " ".join(f"{w}###" for w in words) if k % 2 else " ".join(w for w in words[:8] for _ in range(9))
        docs.append((k, text, "en", "a", 0))
        labels.append((k, int(not bad), int(toxic and not (bad and k % 2 == 0))))
    return docs, labels


def judged(spark, scores, labels, column, rest):
    own = {r.doc_id: r for r in scores.collect() if r.doc_id is not None}
    held = [r for r in labels if own[r[0]].held_out]
    assert all((zlib.crc32(str(r[0]).encode()) % rest[0] == rest[1]) == own[r[0]].held_out for r in labels)
    assert all(0 <= r.score <= 1 for r in own.values())
    return np.mean([own[r[0]].predicted == r[column] for r in held])


def awkward(spark, data):
    return documents(spark, data + [(900, None, None, None, None), (901, "", "", "", 0), (None, "some text", "", "", 0), (902, "word " * 60_000, "", "", 0), data[3]])


def test_quality_of_held_out_rows(spark):
    docs, labels = corpus()
    scores = quality.quality_scores(awkward(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], LABELS))
    assert scores.count() == len(docs) + 5
    assert judged(spark, scores, labels, 1, (4, 2)) > 0.95
    one, two = scores.where("doc_id = 3").collect()
    assert one.score == two.score


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = corpus()
    df = documents(spark, docs)
    kept = quality.drop_low_quality(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids ^ {r[0] for r in labels if r[1] == 1}) < 12


def test_toxicity_of_held_out_rows(spark):
    docs, labels = corpus()
    scores = toxicity.toxicity_scores(awkward(spark, docs), spark.createDataFrame(labels, LABELS))
    assert scores.count() == len(docs) + 5
    assert judged(spark, scores, labels, 2, (5, 0)) > 0.9
    by_id = {r.doc_id: r.predicted for r in scores.collect()}
    assert by_id[900] == by_id[901] == by_id[None] == by_id[902] == 0


def test_without_labels_or_rows(spark):
    none = empty(spark, LABELS)
    assert quality.quality_scores(documents(spark), none).select("score").distinct().count() == 1
    assert toxicity.toxicity_scores(documents(spark), none).count() == len(rows())
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(empty(spark), none).count() == 0


def test_conflicting_labels_do_not_count(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (3, 1, 0), (4, 2, 0), (None, 1, 1)], LABELS)
    assert [tuple(r) for r in fit_labels(df, "quality", 4, 9).collect()] == [(3, 1)]


def test_segments_are_maximal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.integers(-4, 4, rng.integers(0, 14)).astype(float)
        got = toxicity.segments(s)

        def recurse(lo, hi):  # the definition: the best segment, then both rests
            best = max(((s[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            return [] if best[0] <= 0 else [*recurse(lo, best[3]), (best[3], best[4], best[0]), *recurse(best[4], hi)]

        assert sorted(x[2] for x in got) == sorted(x[2] for x in recurse(0, len(s)))
        assert all(s[a:b].sum() == v for a, b, v in got)


def test_a_million_falling_sums_take_seconds():
    # Left sums fall all along: each new segment looks past every one before it.
    s = np.tile([1.0, -2.0], 500_000)
    began = time.process_time()
    assert len(toxicity.segments(s)) == 500_000
    rising = toxicity.segments(np.tile([2.0, -1.0], 500_000))
    assert [x[:2] for x in rising] == [(0, 999_999)]
    nested = np.concatenate([np.tile([1.0, -2.0], 250_000), [1e7], np.tile([1.0, -2.0], 250_000)])
    assert max(x[2] for x in toxicity.segments(nested)) >= 1e7
    assert time.process_time() - began < 20


def test_repeats_raise_the_evidence():
    model = toxicity.Model([("vile", 40.0, 1.0), ("fair", 30.0, 60.0)], 50.0, 100.0)
    scores = toxicity.Scores(model.odds)
    best = [model.evidence(scores, "vile " * n)[0] for n in (1, 2, 3, 4, 8, 100)]
    assert best == sorted(best) and len(set(best)) == 6 and best[-1] < 8 * best[0]
    apart = "vile " + "plain " * 500
    assert len([x for x in toxicity.segments(toxicity.scored_words(scores, apart * 9)[1]) if x[2] > 0]) == 9


def test_passages_that_repeat_are_found_each_time(spark):
    docs, labels = corpus()
    passage = "vilest scumbag rotten vilest scumbag rotten"
    long = " ".join(f"{passage} {prose(random.Random(k), 400)}" for k in range(6))
    df = documents(spark, docs + [(5000, long, "en", "a", 0)])
    model = toxicity.fitted(df, spark.createDataFrame(labels, LABELS), 5, 0)
    words, found = long.split(), [r for r in toxicity.toxic_passages(df, model, p=1.0).collect() if r.doc_id == 5000]
    assert sum(set(words[r.first_word : r.end_word]) >= set(passage.split()) for r in found) == 6


def test_passages(spark):
    docs, labels = corpus()
    df, lab = documents(spark, docs), spark.createDataFrame(labels, LABELS)
    model = toxicity.fitted(df, lab, 5, 0)
    found = {r.doc_id for r in toxicity.toxic_passages(df, model, p=0.05).collect()}
    assert len(found & {r[0] for r in labels if r[2]}) > 0.8 * sum(r[2] for r in labels)


def test_cut_separates():
    assert 0.4 < best_cut(np.array([0.1, 0.4, 0.6, 0.9]), np.array([0, 0, 1, 1])) < 0.6


def test_ranking_minimises_the_bradley_terry_loss():
    # Brute force: the mean logistic loss of feature differences and its gradient, by plain loops, on a small set.
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), (rng.random(40) < 0.5).astype(int)
    x[y == 1] += 0.7
    pairs = [(i, j) for i in range(40) if y[i] for j in range(40) if not y[j]]
    d = np.array([x[i] - x[j] for i, j in pairs])
    w = logistic(d, np.ones(len(d)), l2=1e-3)

    def loss(w):
        return sum(np.log1p(np.exp(-float(w @ r))) for r in d) / len(d) + 1e-3 / 2 * float(w @ w)

    slope = [(loss(w + e) - loss(w - e)) / 2e-5 for e in 1e-5 * np.eye(3)]
    assert np.abs(slope).max() < 1e-6
    assert all(loss(w) <= loss(w + rng.normal(size=3) * 0.1) for _ in range(50))


def test_queries_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, d, "labels").collect()}
    for f, column, rest in ((quality.op10_quality, "quality", (4, 2)), (toxicity.op9_toxicity, "toxic", (5, 0))):
        got = f(spark, d).collect()
        assert len(got) == table(spark, d, "documents").count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1]) for r in got)
        held = [(r.predicted, labels[r.doc_id][column]) for r in got if r.held_out and r.doc_id in labels]
        assert np.mean([a == b for a, b in held]) >= 0.92
