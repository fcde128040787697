import random

import numpy as np
import pytest

from siftwell.operators import training
from pyspark.sql import functions as F


def rows(spark, n=300):
    rng = random.Random(4)
    out = []
    for k in range(n):
        x = [rng.gauss(0, 1) for _ in range(6)] + [2.0]
        z = 0.8 * x[0] - 0.5 * x[1] + 0.3
        out.append((str(k), "s", x, rng.uniform(-0.5, 0.5), bool(rng.random() < 1 / (1 + np.exp(-z)))))
    return spark.createDataFrame(out, "id string, source string, features array<double>, rule_offset double, label boolean"), out


def test_gradient_matches_finite_differences(spark):
    df, _ = rows(spark, 40)
    x, w = training.standardized([0.0] * 7, [1.0] * 7), np.linspace(-0.2, 0.2, 8)
    n, loss, g, _ = training.sums(df, x, w)
    for k in (0, 3, 7):
        step = np.zeros(8)
        step[k] = 1e-5
        slope = (training.sums(df, x, w + step, False)[1] - training.sums(df, x, w - step, False)[1]) / 2e-5
        assert g[k] == pytest.approx(slope, rel=1e-5)


@pytest.mark.parametrize("l2", [0.01, 0.1])
def test_fit_reaches_the_minimum(spark, l2):
    df, data = rows(spark)
    p = training.fit(df, l2)
    training.check_params(p)
    assert p["scales"][6] == 1.0 and p["means"][6] == 2.0  # a constant input
    x = (np.array([r[2] for r in data]) - p["means"]) / p["scales"]
    z = x @ p["weights"] + p["intercept"] + np.array([r[3] for r in data])
    e = 1 / (1 + np.exp(-z)) - np.array([r[4] for r in data])
    assert np.abs(x.T @ e / len(e) + l2 * np.array(p["weights"])).max() < 1e-7 and abs(e.mean()) < 1e-7
    assert training.logits(df, p).orderBy(F.col("id").cast("int")).first().logit == pytest.approx(z[0])


def test_separable_rows_raise_without_penalty(spark):
    df = spark.createDataFrame([([float(k)] + [0.0] * 6, 0.0, k > 5) for k in range(12)], "features array<double>, rule_offset double, label boolean")
    with pytest.raises(RuntimeError):
        training.fit(df, 0.0, steps=5)


def test_splits_and_selection(spark):
    from siftwell.functions.text import split_of

    got = spark.createDataFrame([("00000000ff",), ("00000046",), ("00000055",)], "g string").select(split_of(F.col("g"))).collect()
    assert [r[0] for r in got] == ["train", "validation", "test"]
    c = spark.createDataFrame([(0.01, 0.2, 0.8), (0.1, 0.19, 0.7), (1.0, 0.19, 0.7)], "l2 double, validation_brier double, validation_average_precision double")
    assert training.select_candidate(c).first().l2 == 1.0


def test_invalid_rows(spark):
    df = spark.createDataFrame([("a", "s", [1.0] * 7, 0.0), ("a", "s", [1.0] * 7, 0.0), ("b", "s", [1.0], 0.0), ("c", "s", [float("nan")] * 7, 0.0)], "id string, source string, features array<double>, rule_offset double")
    assert {(r.id, r.error) for r in training.invalid_rows(df).collect()} == {("a", "repeated"), ("b", "width"), ("c", "not finite")}


def test_params_are_checked():
    with pytest.raises(ValueError):
        training.check_params({"means": [0.0] * 7, "scales": [0.0] * 7, "weights": [0.0] * 7, "intercept": 0.0})


def test_models_are_written_read_and_checked(spark, tmp_path):
    path, params = str(tmp_path / "model"), {"l2": 0.1, "means": [0.5] * 7, "scales": [2.0] * 7, "weights": [0.1 * k for k in range(7)], "intercept": -0.3}
    x = [1.0] * 7
    z = -0.3 + sum((1.0 - 0.5) / 2.0 * 0.1 * k for k in range(7))
    training.write_model(spark, path, params, {"parity_vectors": [{"id": "a", "features": x, "residual_logit": z}], "default_eligible": True}, "own", "a command", [{"id": "s"}])
    got, metadata = training.read_model(spark, path)
    assert got == params and metadata["default_eligible"] and metadata["command"] == "a command" and metadata["versions"]["pyspark"] == spark.version
    training.write_model(spark, path, params, {"parity_vectors": [{"id": "a", "features": x, "residual_logit": z + 1}]}, "own", "")
    with pytest.raises(ValueError, match="gives"):
        training.read_model(spark, path)
    from siftwell.sources.sinks import write_json

    row = spark.createDataFrame([("own", (0.1, [0.0] * 7, [1.0] * 7, [0.0] * 7, 0.0), "0" * 64, list(training.MODEL_INPUTS), "{}")], training.MODEL)
    write_json(row, path)
    with pytest.raises(ValueError, match="changed"):
        training.read_model(spark, path)


def test_rows_of_several_files(spark, tmp_path):
    from siftwell.sources.sinks import write_json

    def part(name, ids, names=training.MODEL_INPUTS):
        rows = [(f"{k}", "s", [float(k)] * 7, list(names), 0.0, k % 2 == 0) for k in ids]
        write_json(spark.createDataFrame(rows, "id string, source string, features array<double>, feature_names array<string>, rule_offset double, label boolean"), str(tmp_path / name))
        return str(tmp_path / name)

    a, b = part("a", range(3)), part("b", range(3, 7))
    assert training.load_rows(spark, [a, b]).count() == 7
    with pytest.raises(ValueError, match="repeated"):
        training.load_rows(spark, [a, part("c", [1])])
    with pytest.raises(ValueError, match="other inputs"):
        training.load_rows(spark, [a, part("d", [9], training.MODEL_INPUTS[::-1])])
