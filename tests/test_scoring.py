import math

import pyarrow as pa
import pytest

from siftwell.functions import fingerprint as fp
from siftwell.functions import text as tx
from siftwell.operators import scoring
from siftwell.operators.config import Config
from pyspark.sql import functions as F

#: text → words, links, link ratio, upper ratio, diversity, entropy, word length, spam, slop, reasons; derived by hand-written arithmetic.
GOLDEN = [
    ("", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.154465, 0.062581, []),
    ("hello", 1, 0, 0.0, 0.0, 1.0, 1.921928, 5.0, 0.024127, 0.230824, []),
    ("BUY NOW", 2, 0, 0.0, 1.0, 1.0, 2.584963, 3.0, 0.099750, 0.188320, []),
    ("check out https://a.com and http://b.com now", 6, 2, 0.333333, 0.0, 1.0, 3.942722, 6.5, 0.533284, 0.233971, ["high_link_ratio"]),
    ("spam spam spam spam spam", 5, 0, 0.0, 0.0, 0.2, 2.0, 4.0, 0.249740, 0.116089, ["low_lexical_diversity"]),
    ("BUY CHEAP MEDS NOW CLICK HERE", 6, 0, 0.0, 1.0, 1.0, 3.970176, 4.0, 0.268941, 0.245044, ["excessive_capitalization"]),
]


def one(spark, text, **columns):
    return spark.createDataFrame([(text, *columns.values())], ", ".join(["text string", *(f"{c} string" for c in columns)]))


@pytest.mark.parametrize("row", GOLDEN, ids=lambda r: r[0][:12])
def test_golden(spark, row):
    r = scoring.assess(one(spark, row[0])).select("word_count", "link_count", "link_ratio", "uppercase_ratio", "lexical_diversity", "char_entropy", "avg_word_length", "spam", "slop", "reasons").first()
    assert list(r[:9]) == pytest.approx(row[1:10], abs=1e-6)
    assert r[9] == row[10]


def test_null_text_counts_as_empty(spark):
    assert scoring.assess(one(spark, None)).select("spam", "reasons").first() == scoring.assess(one(spark, "")).select("spam", "reasons").first()


def test_unicode_white_space_and_case_sensitive_links(spark):
    r = one(spark, "a b c　HTTP://x www.y").select(tx.tokens(F.col("text")).alias("t")).select("t", tx.link_count(F.col("t"))).first()
    assert r[0] == ["a", "b", "c", "HTTP://x", "www.y"] and r[1] == 1
    assert one(spark, "   x").select(tx.char_entropy("text")).first()[0] == 0.0


@pytest.mark.parametrize("words,links,fires", [(20, 3, False), (19, 3, True)])
def test_link_rule_is_strict(spark, words, links, fires):
    text = " ".join(["http://x"] * links + [f"w{k}" for k in range(words - links)])
    assert (scoring.assess(one(spark, text)).first()["reasons"] == ["high_link_ratio"]) is fires


@pytest.mark.parametrize("email,domain", [("User@Example.COM", "example.com"), ("not-an-email", None), ("a@", None), ("@b.c", None), ("a@b", None), ("a@b@c.d", "c.d"), ("a@ .", "."), (None, None)])
def test_email_domain(spark, email, domain):
    assert spark.createDataFrame([(email,)], "e string").select(tx.email_domain(F.col("e"))).first()[0] == domain


def test_disposable_suffixes(spark):
    rows = spark.createDataFrame([("mailinator.com",), ("inbox.mailinator.com",), ("mailinator.com.example.org",), ("A.MAILINATOR.COM..",), ("com",), (None,)], "domain string")
    store = spark.createDataFrame([("mailinator.com",), ("com",)], "domain string")
    assert {r[0] for r in scoring.disposable(rows, store).collect()} == {"mailinator.com", "inbox.mailinator.com", "A.MAILINATOR.COM.."}
    assert {r[0] for r in scoring.disposable(rows, store, suffixes=False).collect()} == {"mailinator.com", "com"}


def test_exact_fingerprint_keeps_its_own_score(spark):
    store = spark.createDataFrame([(0, 0.2), (7, 0.9), (255, 1.0)], "fp long, score double")
    asked = spark.createDataFrame([(0,), (3,), (-1,), (None,)], "fp long")
    assert dict(scoring.fingerprint_scores(asked, store).collect()) == {0: 0.2, 3: 0.9}
    assert dict(scoring.fingerprint_scores(asked, store, exact_first=False).collect()) == {0: 0.9, 3: 0.9}


def stores(spark, score):
    return scoring.Stores(
        spark.createDataFrame([("bad.example",)], "domain string"), spark.createDataFrame([("203.0.113", score)], "key string, score double"),
        spark.createDataFrame([("bad.example", score)], "domain string, score double"), spark.createDataFrame([(fp.simhash("some words", "md5"), score)], "fp long, score double"),
    )


@pytest.mark.parametrize("score,reasons", [(0.9, ["ip_reputation_bad", "disposable_email_domain", "email_domain_reputation_bad", "content_fingerprint_seen_spam"]), (0.5, ["disposable_email_domain"])])
def test_reputation_order_and_threshold(spark, score, reasons):
    r = scoring.assess(one(spark, "some words", email="x@bad.example", ip="203.0.113.200"), stores(spark, score)).first()
    assert r["reasons"] == reasons


def test_slop_reason_comes_last(spark):
    r = scoring.assess(one(spark, "spam spam spam spam spam"), cfg=Config(slop_reason_above=0.1)).first()
    assert r["reasons"] == ["low_lexical_diversity", "ai_stylometry_high"]


def test_trained_residual_is_affine(spark):
    from siftwell.plans.sql import PARAMS

    df = spark.createDataFrame([(3, 1, 1 / 3, 0.25, 1.0, 2.0, 5.0)], "word_count long, link_count long, link_ratio double, uppercase_ratio double, lexical_diversity double, char_entropy double, avg_word_length double")
    import math

    x = [math.log1p(3), math.log1p(1), 1 / 3, 0.25, 1.0, 2.0, 5.0]
    want = PARAMS["intercept"] + sum((a - m) / s * w for a, m, s, w in zip(x, PARAMS["means"], PARAMS["scales"], PARAMS["weights"]))
    assert df.select(scoring.residual(PARAMS)).first()[0] == pytest.approx(want, abs=1e-12)


SECRET = "a-network-secret-that-is-long-enough"


@pytest.mark.parametrize("kind", ["md5", "sip"])
def test_hosted_scores_take_the_larger(spark, kind):
    texts = ["own words only", "words of the network", "words of both stores", "words nobody knows"]
    prints = [fp.simhash(t, kind) for t in texts]
    keyed = [fp.signed(fp.network_fingerprint(p, SECRET.encode())) for p in prints]
    own = scoring.Stores(
        spark.createDataFrame([], "domain string"), spark.createDataFrame([], "key string, score double"), spark.createDataFrame([], "domain string, score double"),
        spark.createDataFrame([(prints[0], 0.7), (prints[2], 0.6)], "fp long, score double"), kind=kind,
        network=spark.createDataFrame([(keyed[1], 0.8), (keyed[2], 0.9), (prints[3], 1.0)], "fp long, score double"), secret=SECRET,
    )
    got = {r.text: r.fp_score for r in scoring.assess(spark.createDataFrame([(t,) for t in texts], "text string"), own).collect()}
    assert got == {texts[0]: 0.7, texts[1]: 0.8, texts[2]: 0.9, texts[3]: None}


def test_ipv6_networks_fire(spark):
    own = scoring.Stores(spark.createDataFrame([], "domain string"), spark.createDataFrame([("2001:db8:1", 0.9)], "key string, score double"), spark.createDataFrame([], "domain string, score double"), spark.createDataFrame([], "fp long, score double"))
    asked = spark.createDataFrame([("a", "2001:0DB8:1:ffff::7"), ("b", "2001:db8:2::7"), ("c", "203.0.113.7"), ("d", None)], "text string, ip string")
    assert {r.text: r.reasons for r in scoring.assess(asked, own).collect()} == {"a": ["ip_reputation_bad"], "b": [], "c": [], "d": []}


def test_fingerprints_are_computed_in_two_places_at_most(spark):
    plan = scoring.assess(one(spark, "some words", email="x@bad.example", ip="203.0.113.200"), stores(spark, 0.9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("simhash_md5(") <= 2 and plan.count("char_entropy(") <= 2


def test_stores_are_seeded_and_updated(spark, tmp_path):
    from siftwell.operators.stores import open_stores, upserted

    folder = str(tmp_path)
    names = spark.createDataFrame([(" bad.example ",), ("# no",), ("",), ("Upper.example",)], "value string")
    ranges = spark.createDataFrame([("203.0.113 0.9",), ("# 1.2.3 0.4",)], "value string")
    for _ in range(2):  # opening again changes nothing
        got = open_stores(spark, folder, names, ranges)
        assert {r[0] for r in got.disposable.collect()} == {"bad.example", "Upper.example"} and [tuple(r) for r in got.ips.collect()] == [("203.0.113", 0.9)]
        assert got.fingerprints.count() == 0 and got.network is None
    upserted(spark, folder, "ips", spark.createDataFrame([("203.0.113", 0.4), ("203.0.114", 0.3), ("203.0.114", 0.6), (None, 1.0)], "key string, score double"))
    assert {tuple(r) for r in open_stores(spark, folder).ips.collect()} == {("203.0.113", 0.4), ("203.0.114", 0.6)}
    upserted(spark, folder, "network", spark.createDataFrame([(7, 0.5)], "fp long, score double"))
    assert open_stores(spark, folder, secret=SECRET).network.count() == 1


def counted(monkeypatch, path):
    """Puts a fingerprint in place that leaves a byte at ``path`` for each text it gets."""
    own = str(path)

    def prints(text):
        from siftwell.functions.fingerprint import simhash

        with open(own, "a") as f:
            f.write("x")
        return simhash(text, "md5")

    monkeypatch.setattr(fp, "simhash_md5", F.udf(prints, "long"))


def test_lookups_compute_a_fingerprint_once(spark, monkeypatch, tmp_path):
    counted(monkeypatch, tmp_path / "texts")
    df = spark.createDataFrame([(f"text {k}",) for k in range(30)] + [(None,)], "text string")
    known = spark.createDataFrame([(fp.simhash("text 1", "md5"), 0.9)], "fp long, score double")
    got = scoring.fingerprint_scores(df.select(fp.simhash_md5("text").alias("fp")), known, exact_first=False).collect()
    assert (tmp_path / "texts").stat().st_size == 31 and known.first().fp in {r.fp for r in got}


def test_kept_columns_go_on_and_texts_are_read_once(spark, monkeypatch, tmp_path):
    rows = [(k, f"buy http://a.b {k % 4} now", f"u@x{k % 3}.example", "203.0.1.7" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, email string, ip string")
    stores = scoring.Stores(
        disposable=spark.createDataFrame([("x1.example",)], "domain string"), ips=spark.createDataFrame([("203.0.1", 0.9)], "key string, score double"),
        domains=spark.createDataFrame([("x2.example", 0.8)], "domain string, score double"), fingerprints=spark.createDataFrame([(fp.simhash(rows[1][1], "md5"), 0.9)], "fp long, score double"),
    )
    out = lambda d: sorted((r.id, r.spam, r.slop, tuple(r.reasons)) for r in d.select("id", "spam", "slop", "reasons").collect())
    want = out(scoring.assess(df, stores))
    counted(monkeypatch, tmp_path / "texts")
    kept = scoring.assess(df, stores, keep=("id",))
    assert out(kept) == want and (tmp_path / "texts").stat().st_size == 40 and "text" not in kept.columns
    assert out(scoring.assess(df, keep=("id",))) == out(scoring.assess(df))


def test_entropy_counts_long_texts_in_pieces():
    for text in (None, "", " \u3000", "a" * 300_000 + "b" * 300_000, "\U0001f600x " * 200_000, "é" * 5 + "a" * 270_000):
        own = "".join((text or "").split())
        share = [own.count(c) / len(own) for c in set(own)]
        assert tx.entropy(text) == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-9)


def test_entropy_takes_slices_of_a_batch(monkeypatch):
    rows, whole = [], tx.in_slices
    monkeypatch.setattr(tx, "in_slices", lambda texts, of: whole(texts, lambda some: rows.append(len(some)) or of(some)))
    got = tx.char_entropy.func(pa.array(["ab", None] * 1000))
    assert got.to_pylist() == [1.0, 0.0] * 1000 and sum(rows) == 2000 and max(rows) <= 256
