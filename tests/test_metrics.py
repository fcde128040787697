import pytest

from siftwell.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label boolean")


def test_golden(spark):
    r = metrics.signal_metrics(scored(spark, [(0.9, True), (0.8, False), (0.7, True), (0.1, False)]), 0.75).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and r.precision == r.recall == r.f1 == 0.5
    assert r.brier == pytest.approx(0.1875) and r.ece == pytest.approx(0.325) and r.average_precision == pytest.approx(5 / 6)


def test_undefined_values_are_null(spark):
    r = metrics.signal_metrics(scored(spark, [(0.2, False), (0.1, False)]), 0.5).first()
    assert r.precision is r.recall is r.f1 is r.average_precision is None


def test_f1_is_zero_when_both_are(spark):
    assert metrics.signal_metrics(scored(spark, [(0.9, False), (0.1, True)]), 0.5).first().f1 == 0.0


@pytest.mark.parametrize("rows", [[(0.5, True), (0.5, False)], [(0.5, False), (0.5, True)]])
def test_ties_count_together(spark, rows):
    assert metrics.average_precision(scored(spark, rows)).first()[0] == 0.5


def test_threshold_is_inclusive(spark):
    assert metrics.confusion(scored(spark, [(0.5, True)]), 0.5).first().tp == 1


def test_bins_differ_at_one_edge(spark):
    edge = scored(spark, [(0.8999999999999999, False), (0.85, True)])
    assert metrics.ece(edge).first()[0] == pytest.approx(0.5 * 0.9 + 0.5 * 0.15)
    assert metrics.ece(edge, ranges=True).first()[0] == pytest.approx(abs(0.875 - 0.5))


def test_invalid_values(spark):
    bad = scored(spark, [(float("nan"), True), (-0.1, True), (1.1, True), (1.0, True), (0.0, True), (None, True)])
    assert metrics.invalid_scores(bad).count() == 4
    for t in (float("nan"), -0.1, 1.1):
        with pytest.raises(ValueError):
            metrics.check_threshold(t)


def test_average_precision_over_many_slices(spark):
    import random

    rng = random.Random(2)
    rows = [(round(rng.random(), 3), rng.random() < 0.3) for _ in range(2000)]
    pos = sum(y for _, y in rows)
    area = 0.0
    for s in {s for s, _ in rows}:
        above = [y for t, y in rows if t >= s]
        area += sum(y for t, y in rows if t == s) / pos * sum(above) / len(above)
    assert metrics.average_precision(scored(spark, rows)).first()[0] == pytest.approx(area)
