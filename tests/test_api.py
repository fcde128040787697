import json

import pytest

from siftwell.__main__ import main
from siftwell.operators import training
from siftwell.plans import api

SPAM = ["WIN A PRIZE http://a.example http://b.example TODAY", "CHEAP CHEAP PILLS https://c.example https://d.example NOW", "FREE FREE OFFER www.e.example www.f.example CLICK", "LIMITED DEAL https://g.example https://h.example BUY"]
HAM = ["The retry case needs a test before we merge this change.", "My zipper broke after two days and support never answered.", "I moved the call to Tuesday because two of us are away.", "Less salt and ten more minutes in the oven did the trick."]


def corpus(tmp_path, extra=()):
    rows = [{"id": f"s{k}", "text": t, "context": "comment", "spam": True} for k, t in enumerate(SPAM)] + [{"id": f"h{k}", "text": t, "spam": False, "slop": False} for k, t in enumerate(HAM)]
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join([*map(json.dumps, rows), *extra]))
    return str(path)


def test_regression_floors(spark, tmp_path):
    got = {r.signal: r for r in api.evaluate(spark, corpus(tmp_path)).collect()}
    assert got["spam"].labelled == 8 and got["spam"].precision >= 0.75 and got["spam"].recall >= 0.5
    assert got["slop"].labelled == 4 and got["slop"].average_precision is None


def test_first_fault_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="line 10: empty_text"):
        api.evaluate(spark, corpus(tmp_path, ["", '{"id":"x","text":" ","spam":true}', "{"]))
    (tmp_path / "none").write_text("\n\n")
    with pytest.raises(ValueError, match="no records"):
        api.evaluate(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="threshold"):
        api.evaluate(spark, "never read", 1.5)


def test_export_and_command_line(spark, tmp_path, capsys):
    main(["export-spam-features", "--input", corpus(tmp_path), "--source", "own", "--output", str(tmp_path / "rows")])
    assert json.loads(capsys.readouterr().out) == {"records": 8}
    rows = spark.read.json(str(tmp_path / "rows"))
    assert rows.count() == 8 and set(rows.columns) == {"id", "source", "text_group", "label", "rule_offset", "baseline_logit", "features", "feature_names", "split"}
    main(["evaluate", "--input", corpus(tmp_path)])
    assert json.loads(capsys.readouterr().out)["spam"]["positive"] == 4


def test_batches_keep_order_and_cap(spark):
    item = "struct<text:string,author_ip:string,author_email:string>"
    df = spark.createDataFrame([(1, [("hello", None, None), (SPAM[0], "::1", "a@b.c")]), (2, [("x", None, None)] * 1000)], f"batch int, items array<{item}>")
    got = api.check_batches(df).collect()
    assert len(got) == 1002 and [r.item for r in got[:2]] == [0, 1] and got[1].spam > 0.5 > got[0].spam
    with pytest.raises(Exception, match="too many items"):
        api.check_batches(spark.createDataFrame([(1, [("x", None, None)] * 1001)], df.schema)).collect()


def test_feedback_keeps_no_text(spark):
    schema = "seq long, tenant string, text string, verdict string"
    assert api.votes_of(spark.createDataFrame([(1, "t", "x" * 65_536, "spam")], schema)).columns == ["seq", "tenant", "fp", "verdict"]
    with pytest.raises(Exception, match="too long"):
        api.votes_of(spark.createDataFrame([(1, "t", "x" * 65_537, "spam")], schema)).collect()


def test_training_from_text_to_model(spark):
    import random

    rng = random.Random(11)
    rows = []
    for k in range(240):
        spam = rng.random() < 0.4
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "pi", "rho"]) + str(rng.randrange(30)) for _ in range(rng.randint(6, 30))]
        if spam or rng.random() < 0.15:
            words = [w.upper() if rng.random() < 0.6 else w for w in words] + ["http://x.example"] * rng.randint(0, 3)
        rows.append((str(k), " ".join(words), spam))
    exported = training.export_features(spark.createDataFrame(rows, "id string, text string, label boolean"), "made")
    params, report = training.train(exported, grid=(0.1, 1.0))
    assert params["l2"] in (0.1, 1.0) and len(report["candidates"]) == 2 and sum(report["counts"].values()) == 240
    assert isinstance(report["default_eligible"], bool) and report["trained"]["brier"] < 0.25
    with pytest.raises(ValueError, match="differ"):
        training.train(exported.limit(50).unionByName(exported.limit(1).selectExpr("'z' AS id", "source", "text_group", "NOT label AS label", "rule_offset", "baseline_logit", "features", "split")))
