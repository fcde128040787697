import pytest
from pyspark.sql import functions as F

from siftwell.operators import feedback, limits


def votes(spark, rows):
    return spark.createDataFrame([(k, t, 1, v) for k, (t, v) in enumerate(rows)], "seq long, tenant string, fp long, verdict string")


def test_consensus(spark):
    v = votes(spark, [("a", "spam"), ("a", "spam"), ("b", "spam"), ("c", "spam"), ("a", "ham")])
    got = [(r.changed, r.distinct_tenants) for r in feedback.receipts(v).orderBy("seq").collect()]
    assert got == [(True, 1), (False, 1), (True, 2), (True, 3), (True, 3)]
    assert feedback.network_scores(v).first().score == pytest.approx(2 / 3)
    r = feedback.aggregates(v).first()
    assert (r.spam, r.ham, r.packed) == (2, 1, (2 << 32) | 1)
    assert feedback.network_scores(v.where("seq < 3")).count() == 0
    assert feedback.network_scores(v.where("seq < 4")).first().score == 1.0


def test_faults(spark):
    assert feedback.unknown_verdicts(votes(spark, [("a", "spam"), ("a", "maybe"), ("b", None)])).count() == 2
    with pytest.raises(ValueError):
        feedback.check_secret(b"short")


def test_receipts_equal_a_replay(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("abcd"), rng.choice(["spam", "ham"])) for _ in range(200)]
    last, want = {}, []
    for t, v in rows:
        want.append((last.get(t) != v, len(last | {t: v})))
        last[t] = v
    assert [(r.changed, r.distinct_tenants) for r in feedback.receipts(votes(spark, rows)).orderBy("seq").collect()] == want


def test_rate_limit(spark):
    times = [0, 10, 59, 60, 61, 119, 121, 125]
    df = spark.createDataFrame([(k, "a", float(t)) for k, t in enumerate(times)] + [(100, "b", 10.0)], "id long, tenant string, at double")
    got = limits.rate_limited(df, 2).orderBy("id").collect()
    assert [r.accepted for r in got] == [True, True, False, True, True, False, True, True, True]
    assert [r.retry_after for r in got] == [None, None, 1, None, None, 1, None, None, None]
    with pytest.raises(ValueError):
        limits.rate_limited(df, 0)


def test_bearer(spark):
    rows = [(["Bearer x"],), (["bearer  x"],), (["Basic x"],), (["Bearer x y"],), (["Bearer x", "Bearer x"],), ([],), (None,), (["Bearer"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<string>").select(limits.bearer_token(F.col("h"))).collect()]
    assert got == ["x", "x", None, None, None, None, None, None]


def test_credentials(spark):
    k = "k" * 32
    rows = [(1, "a", k), (2, "b", k), (3, "a", k + "3"), (4, "", k + "4"), (5, "x" * 65, k + "5"), (6, "ok-_9", "k" * 31), (7, "bad tenant", "short")]
    got = {r.row: r.error for r in limits.credential_errors(spark.createDataFrame(rows, "row long, tenant string, api_key string")).collect()}
    assert got == {1: None, 2: "duplicate_key", 3: "duplicate_tenant", 4: "invalid_tenant", 5: "invalid_tenant", 6: "too_short", 7: "too_short"}


def test_sizes(spark):
    df = spark.createDataFrame([("\U0001f600a",), ("",), (None,)], "t string")
    assert df.select(limits.utf16_units(F.col("t"))).first()[0] == 3
    null = F.lit(None).cast("string")
    assert [r[0] for r in df.select(limits.tool_input_ok(F.col("t"), null, null, null)).collect()] == [True, False, False]


def test_key_list(spark):
    r = spark.createDataFrame([(" a = b=c ,, d",)], "v string").select(limits.parse_key_list(F.col("v"))).first()[0]
    assert [tuple(x) for x in r] == [("a", "b=c"), ("d", None)]


def test_credentials_are_refused_as_a_whole(spark):
    schema = "row long, tenant string, api_key string"
    good = spark.createDataFrame([(1, "a", "k" * 32)], schema)
    assert limits.check_credentials(good).count() == 1
    for rows, per_minute, message in ((spark.createDataFrame([], schema), 1, "no credentials"), (good, 0, "positive"), (spark.createDataFrame([(1, "a", "short")], schema), 1, "too_short")):
        with pytest.raises(ValueError, match=message):
            limits.check_credentials(rows, per_minute)


def test_counts_that_need_more_than_a_counter_raise(spark, monkeypatch):
    votes = spark.createDataFrame([(k, f"t{k}", 1, "spam") for k in range(4)], "seq long, tenant string, fp long, verdict string")
    assert feedback.unpacked(feedback.aggregates(votes)).first() == (1, 4, 0)
    monkeypatch.setattr(feedback, "MOST", 3)
    with pytest.raises(Exception, match="more votes"):
        feedback.aggregates(votes).collect()


def test_modes():
    from siftwell.operators.config import mode_of

    assert not mode_of({}).hosted and not mode_of({"mode": "self-hosted", "stores": "x"}).hosted
    own = mode_of({"mode": "hosted", "secret": "s", "keys": "a=b", "rate_limit_per_minute": "7"})
    assert own.hosted and own.per_minute == 7 and own.network == "stores-network"
    for bad in ({"mode": "other"}, {"mode": "hosted", "keys": "a=b"}, {"mode": "hosted", "secret": "s"}, {"mode": "hosted", "secret": "s", "keys": "a=b", "rate_limit_per_minute": "0"}, {"mode": "hosted", "secret": "s", "keys": "a=b", "rate_limit_per_minute": "x"}):
        with pytest.raises(ValueError):
            mode_of(bad)
