"""Fits the residual classifier: logistic regression with an offset, by Newton steps on DataFrame aggregates."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import MODEL_INPUTS, model_inputs, split_of, text_group, with_features
from siftwell.operators import metrics
from siftwell.operators.scoring import baseline_spam, rule_offset, sigmoid
from siftwell.sources.sinks import staged, swap, written_beside

#: The ridge strengths of the grid.
GRID = (0.0, 0.01, 0.1, 1.0, 10.0)
WIDTH = len(MODEL_INPUTS)


def export_features(records: DataFrame, source: str) -> DataFrame:
    """Training rows of the records (id, text, label) with a label: text group, offset, baseline logit, inputs, split."""
    df = with_features(records.where("label IS NOT NULL"))
    group = text_group(F.col("text"))
    return df.select("id", F.lit(source).alias("source"), group.alias("text_group"), "label", rule_offset().alias("rule_offset"), (rule_offset() + baseline_spam()).alias("baseline_logit"), model_inputs().alias("features"), split_of(group).alias("split"))


def invalid_rows(rows: DataFrame) -> DataFrame:
    """(source, id, error) of training rows that are repeated, of the wrong width or not finite."""
    width = F.size("features") != WIDTH
    odd = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.isnan("rule_offset") | F.col("rule_offset").isNull()
    faults = rows.select("source", "id", F.when(width, "width").when(odd, "not finite").alias("error")).where("error IS NOT NULL")
    return faults.unionByName(rows.groupBy("source", "id").count().where("count > 1").select("source", "id", F.lit("repeated").alias("error")))


def label_conflicts(rows: DataFrame) -> DataFrame:
    """Text groups whose rows have differing labels."""
    return rows.groupBy("text_group").agg(F.count_if("label").alias("positive"), F.count("*").alias("n")).where("positive > 0 AND positive < n")


def moments(train: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation of each input; 1 where it is 0."""
    x = [F.col("features")[k] for k in range(WIDTH)]
    row = train.agg(*(f(c) for f in (F.avg, F.stddev_pop) for c in x)).first()
    return list(row[:WIDTH]), [s or 1.0 for s in row[WIDTH:]]


def standardized(means: list[float], scales: list[float]) -> list[Column]:
    return [(F.col("features")[k] - float(means[k])) / float(scales[k]) for k in range(WIDTH)]


def sums(train: DataFrame, x: list[Column], params: np.ndarray, hessian: bool = True):
    """(rows, loss sum, gradient sums, Hessian sums) of the logistic loss with offset: one aggregate over all rows."""
    z = F.col("rule_offset") + F.lit(float(params[-1]))
    for c, w in zip(x, params):
        z = z + c * float(w)
    y = F.col("label").cast("double")
    cols = [*x, F.lit(1.0)]
    rows = train.select(z.alias("z"), y.alias("y"), *(c.alias(f"x{k}") for k, c in enumerate(cols)))
    p = sigmoid(F.col("z"))
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
    aggs = [F.count("*"), F.sum(loss), *(F.sum((p - F.col("y")) * F.col(f"x{k}")) for k in range(len(cols)))]
    if hessian:
        aggs += [F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(len(cols)) for j in range(i + 1)]
    row = rows.agg(*aggs).first()
    k = len(cols)
    h = np.zeros((k, k))
    if hessian:
        for v, (i, j) in zip(row[2 + k :], ((i, j) for i in range(k) for j in range(i + 1))):
            h[i, j] = h[j, i] = v
    return row[0], row[1], np.array(row[2 : 2 + k]), h


def fit(train: DataFrame, l2: float, steps: int = 50) -> dict:
    """means, scales, weights, intercept at the minimum of the mean loss plus l2/2 of the squared weights.

    The intercept has no penalty. Raises if the gradient doesn't vanish within ``steps``, as on separable rows
    without a penalty. The inputs are written once; each step reads them.
    """
    train = staged(train.select("features", "rule_offset", "label"), "train")
    means, scales = moments(train)
    x, w = standardized(means, scales), np.zeros(WIDTH + 1)
    ridge = np.append(np.full(WIDTH, l2), 0.0)
    n, loss, g, h = sums(train, x, w)
    for _ in range(steps):
        gradient = g / n + ridge * w
        if np.abs(gradient).max() < 1e-8:
            return {"l2": l2, "means": means, "scales": scales, "weights": w[:-1].tolist(), "intercept": float(w[-1])}
        step, size, value = np.linalg.solve(h / n + np.diag(ridge) + 1e-12 * np.eye(WIDTH + 1), gradient), 1.0, loss / n + (ridge * w * w).sum() / 2
        while True:
            new = w - size * step
            got = sums(train, x, new)
            if got[1] / n + (ridge * new * new).sum() / 2 <= value + 1e-15 or size < 1e-4:
                break
            size /= 2
        w, (n, loss, g, h) = new, got
    raise RuntimeError(f"the fit at l2={l2} did not converge")


def logits(rows: DataFrame, params: dict) -> DataFrame:
    """``rows`` with ``logit``: offset plus trained residual."""
    z = F.col("rule_offset") + float(params["intercept"])
    for c, w in zip(standardized(params["means"], params["scales"]), params["weights"]):
        z = z + c * float(w)
    return rows.withColumn("logit", z)


def check_params(params: dict) -> None:
    """Raises unless there are seven finite means, scales other than 0 and weights, and a finite intercept."""
    lists = [params["means"], params["scales"], params["weights"]]
    if any(len(x) != WIDTH for x in lists) or not all(map(math.isfinite, [*sum(lists, []), params["intercept"]])) or not all(params["scales"]):
        raise ValueError("model parameters must be seven finite means, scales and weights, no scale 0")


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate (l2, validation_brier, validation_average_precision) of least Brier, then most precision, then most l2."""
    return candidates.orderBy("validation_brier", F.desc("validation_average_precision"), F.desc("l2")).limit(1)


def load_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Training rows of several JSON-lines files (source, id, features, feature_names, rule_offset, baseline_logit, label, split).

    Raises on a file whose rows name other inputs than MODEL_INPUTS or in another order, and on faulty rows.
    """
    schema = "source string, id string, text_group string, features array<double>, feature_names array<string>, rule_offset double, baseline_logit double, label boolean, split string"
    rows = spark.read.schema(schema).json(paths)
    own = F.array(*map(F.lit, MODEL_INPUTS))
    other = rows.where(~F.coalesce(F.col("feature_names") == own, F.lit(False))).select(F.col("_metadata.file_path")).first()
    if other:
        raise ValueError(f"{other[0]} has other inputs than {', '.join(MODEL_INPUTS)}")
    rows = staged(rows.drop("feature_names"), "rows")
    fault = invalid_rows(rows).first()
    if fault:
        raise ValueError(f"row {fault.source}:{fault.id}: {fault.error}")
    return rows


def candidates_of(validation: DataFrame, found: dict[float, dict]) -> DataFrame:
    """(l2, validation_brier, validation_average_precision) of each fitted strength, in one pass over the rows."""
    scored = validation
    for k, params in enumerate(found.values()):
        scored = logits(scored, params).withColumnRenamed("logit", f"_z{k}")
    each = F.explode(F.array(*(F.struct(F.lit(float(l2)).alias("l2"), F.col(f"_z{k}").alias("z")) for k, l2 in enumerate(found)))).alias("c")
    long = scored.select(each, "label").select("c.l2", sigmoid(F.col("c.z")).alias("score"), "label")
    return metrics.signal_metrics(long, by=("l2",)).select("l2", F.col("brier").alias("validation_brier"), F.col("average_precision").alias("validation_average_precision"))


def train(rows: DataFrame, grid=GRID) -> tuple[dict, dict]:
    """(params, report) of exported rows: fitted on train by each ridge strength, chosen on validation, reported on test.

    Raises on faulty rows, on text groups of differing labels, and on a split without both classes. The report
    holds each candidate's validation metrics, both classifiers' test metrics, three parity vectors (the first test
    rows by source and id), and whether the trained one has the lower Brier score and the higher average precision.
    Strengths whose fit diverges are left out.
    """
    rows = staged(rows, "rows")
    if not invalid_rows(rows).isEmpty():
        raise ValueError("training rows are repeated, of the wrong width or not finite")
    if not label_conflicts(rows).isEmpty():
        raise ValueError("rows of one text group differ in their label")
    both = {r[0]: r[1] for r in rows.groupBy("split").agg(F.count_distinct("label")).collect()}
    if any(both.get(s) != 2 for s in ("train", "validation", "test")):
        raise ValueError("each split needs both classes")
    part = {s: rows.where(F.col("split") == s) for s in both}
    found = {}
    for l2 in grid:
        try:
            params = fit(part["train"], l2)
        except RuntimeError:
            continue
        check_params(params)
        found[l2] = params
    candidates = staged(candidates_of(part["validation"], found), "candidates")
    params = found[select_candidate(candidates).first().l2]
    test = logits(part["test"], params)
    long = test.select(F.expr("stack(2, 'baseline', baseline_logit, 'trained', logit) AS (classifier, z)"), "label").select("classifier", sigmoid(F.col("z")).alias("score"), "label")
    by = {r.classifier: r.asDict() for r in metrics.compared(long, "classifier", "trained", "baseline").collect()}
    report: dict = {name: {k: v for k, v in r.items() if k not in ("classifier", "default_eligible")} for name, r in by.items()}
    report["candidates"] = [tuple(r) for r in candidates.orderBy("l2").collect()]
    report["counts"] = {r[0]: r[1] for r in rows.groupBy("split").count().collect()}
    report["default_eligible"] = by["trained"]["default_eligible"]
    first = test.orderBy("source", "id") if "source" in test.columns else test.orderBy("id")
    report["parity_vectors"] = [{"id": r.id, "features": list(r.features), "residual_logit": r.logit - r.rule_offset} for r in first.limit(3).collect()]
    return params, report


MODEL = "name string, params struct<l2:double,means:array<double>,scales:array<double>,weights:array<double>,intercept:double>, sha256 string, feature_names array<string>, metadata string"


def params_digest(params: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    own = {k: [float(x) for x in v] if isinstance(v, (list, tuple)) else float(v) for k, v in params.items()}
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


def write_model(spark: SparkSession, path: str, params: dict, report: dict, name: str, command: str, sources: list[dict] | None = None) -> None:
    """Writes the model as one JSON record: parameters, their digest, the inputs' names, and metadata (the report, the split
    policy, versions, sources and the command). An old model stays until the new one is whole."""
    check_params(params)
    metadata = dict(report) | {
        "split_policy": "first 32 bits of the text group mod 100: train 0..69, validation 70..84, test 85..99", "selected_l2": params.get("l2"), "sources": sources or [],
        "versions": {"pyspark": spark.version, "numpy": np.__version__}, "command": command,
    }
    own = {"l2": float(params.get("l2") or 0.0), **{k: [float(x) for x in params[k]] for k in ("means", "scales", "weights")}, "intercept": float(params["intercept"])}
    row = (name, own, params_digest(own), list(MODEL_INPUTS), json.dumps(metadata, sort_keys=True, default=float))
    swap(spark, {path: written_beside(spark.createDataFrame([row], MODEL).coalesce(1), path)})


def read_model(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(params, metadata) of a written model; raises if its digest, inputs, parameters or parity vectors don't hold."""
    rows = spark.read.schema(MODEL).json(path).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} holds no model")
    params, metadata = rows[0].params.asDict(), json.loads(rows[0].metadata)
    check_params(params)
    if params_digest(params) != rows[0].sha256 or tuple(rows[0].feature_names) != MODEL_INPUTS:
        raise ValueError(f"the model of {path} has changed or takes other inputs")
    for v in metadata.get("parity_vectors", []):
        z = params["intercept"] + sum((x - m) / s * w for x, m, s, w in zip(v["features"], params["means"], params["scales"], params["weights"]))
        if not math.isclose(z, v["residual_logit"], rel_tol=1e-5, abs_tol=1e-5):
            raise ValueError(f"the model of {path} gives {z} for {v['id']}, not {v['residual_logit']}")
    return params, metadata
