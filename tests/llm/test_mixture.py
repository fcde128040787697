import re

from pyspark.sql import functions as F

from siftwell.llm import mixture as m
from siftwell.llm.common import table
from tests.llm import helpers
from tests.llm.helpers import documents, empty, prose, rows
import random


def brute_targets(sizes, weights):
    total, caps = sum(sizes.values()), {k: 3 * v for k, v in sizes.items()}
    capped, out = set(), {}
    while True:
        rest = total - sum(caps[k] for k in capped)
        free = sum(w for k, w in weights.items() if k not in capped)
        out = {k: caps[k] if k in capped else rest * w / free for k, w in weights.items()}
        over = {k for k in out if k not in capped and out[k] > caps[k]}
        if not over:
            return out
        capped |= over


def many(spark):
    rng = random.Random(5)
    data = rows() + [(5000 + k, prose(rng, rng.randint(1, 9)), "en", rng.choice(["small", "Z", "é"]), 0) for k in range(40)] + [(6000 + k, prose(rng, 400), "en", "huge", 0) for k in range(60)]
    return data, documents(spark, data)


def test_targets_equal_water_filling(spark):
    data, df = many(spark)
    got = m.mix(df, m.cycling_weights).collect()
    assert len(got) == len(data)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes)  # a capped source is among them
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, m.mix(df.repartition(5), m.cycling_weights).collect()))


def test_no_python_in_the_plan(spark):
    _, df = many(spark)
    plan = m.mix(df, m.cycling_weights)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_curriculum_inverts_demand(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "a" if k % 2 else "b") for k in range(400)], "doc_id long, text string, source string")
    pieces = [("0a", 0.0, 0.5, 1.0), ("0a", 0.5, 1.0, 3.0), ("0b", 0.0, 0.5, 3.0), ("0b", 0.5, 1.0, 1.0)]
    got = m.mix(docs, spark.createDataFrame(pieces, "key string, begins double, ends double, weight double"))
    early = {r.source: r.n for r in got.where("position < 0.5").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(early["a"] - 50) <= 2 and abs(early["b"] - 150) <= 2


def test_arranged_repeats_and_orders(spark):
    data, df = many(spark)
    df = df.unionByName(documents(spark, [(3, "another text of the id three", "en", "a", 0), (None, "a second one without an id", "en", "b", 0)]))
    out = m.arranged(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in m.mix(df, m.cycling_weights).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect()}
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == copies and None in got and got[3] >= 2


def test_weights_change_over_time_and_integrate(spark):
    for n in (1, 2, 3, 7):
        rows = m.cycling_weights(spark.createDataFrame([(f"0{k}", 10) for k in range(n)], "key string, source_size long")).collect()
        area, at = {}, {}
        for r in rows:
            assert r.weight > 0
            area[r.key] = area.get(r.key, 0) + r.weight * (r.ends - r.begins)
            at[r.begins] = at.get(r.begins, 0) + r.weight
        assert all(abs(area[f"0{k}"] - (k % 3 + 1)) < 1e-9 for k in range(n)) and max(at.values()) - min(at.values()) < 1e-9
        assert n == 1 or len({round(r.weight, 9) for r in rows if r.key == "00"}) == m.PIECES


def test_early_positions_hold_more_of_the_first_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(2000)], "doc_id long, text string, source string")
    first = m.mix(docs, m.cycling_weights).where("source = 'a' AND copies > 0").agg(F.avg((F.col("position") < 0.5).cast("int"))).first()[0]
    assert abs(first - (0.5 + 2 / 3 * 0.25)) < 0.02  # the integral of the first half


def test_query_is_whole_native_and_sorted(spark):
    d = "/root/testdata/sf0.01"
    out = m.op7_mixture(spark, d)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
    got, docs = out.collect(), {r.doc_id: r for r in table(spark, d, "documents").collect()}
    assert [r.position for r in got] == sorted((r.position for r in got), key=lambda p: (p is not None, p)) and {r.doc_id for r in got} == set(docs)
    taken, of = {}, {}
    for r in got:
        source = docs[r.doc_id].source
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken <= 3 * r["size"]
        taken[source], of[source] = taken.get(source, 0) + r.taken, r
    want = brute_targets({s: r.source_size for s, r in of.items()}, {s: k % 3 + 1 for k, s in enumerate(sorted(of, key=lambda s: (s is None, s or "")))})
    assert all(abs(taken[s] - want[s]) <= 1 and abs(of[s].target - want[s]) < 1e-6 * want[s] for s in of)


def test_arranged_of_empty_and_blank_tables(spark):
    assert m.arranged(empty(spark)).count() == 0
    assert m.arranged(spark.createDataFrame([(1, None, "en", None, 0), (None, "", "en", "a", 0)], helpers.SCHEMA)).count() == 0


def test_empty_tables(spark):
    assert m.mix(empty(spark), m.cycling_weights).count() == 0
    blank = m.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string"), m.cycling_weights).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2
