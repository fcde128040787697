import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm.common import Forest, shared_dir, table
from tests.llm.helpers import documents, empty, rows

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 200 > len(kept[0]) > len(kept[1]) > len(kept[2]) > 100
    assert kept[0] > kept[1] > kept[2] >= kept[3]
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    assert sum(labels.get(d) == 0 for d in kept[0]) == 0
    assert sum(q == 1 and d not in kept[0] for d, q in labels.items()) <= 2


LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"


@pytest.fixture(params=["full", "empty"])
def folder(spark, tmp_path, request):
    """A folder with small or empty labels and benchmark."""
    full = request.param == "full"
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(None, 1, 0), (3, None, None)] if full else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    item = next(r for r in rows() if r[0] == 7)[1]
    spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")] if full else [], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_awkward_rows(spark, folder):
    # Nulls in any column, empty and long texts, repeated rows and ids, extra columns with clashing names.
    docs = documents(spark).withColumns({c: F.lit("x") for c in ("text_hash", "times", "first_id", "file", "row", "name", "slot", "shard", "own", "pack", "at", "copies", "target")})
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, "stage-test")
        docs.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        out = stage(spark, docs, folder)
        if name != "token_shards":
            assert out.columns == before.columns
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert kept <= {(r.doc_id, r.text) for r in docs.collect()} and kept
            if name == "near_duplicates":
                assert out.count() == len(kept) and len({t or "" for _, t in kept if not (t or "").split()}) <= 1
            docs = out
        else:
            assert {d for r in out.collect() for d in r.doc_ids} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark, folder):
    path = shared_dir(spark, "stage-test")
    empty(spark).write.parquet(path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(path), folder).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    # Of sf0.001: the exact Jaccard of five-word shingles of every pair, groups by links, the smallest id of each stays.
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    sets = []
    for t in docs.values():
        own = (t or "").encode().lower().split()
        sets.append({tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set())
    ids, f = list(docs), Forest(len(docs))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                f.join(np.array([i]), np.array([j]))
    least = {}
    for r, d in zip(f.root.tolist(), ids):
        least[r] = min(d, least.get(r, d))
    kept = corpus_pipeline.near_duplicates(spark, table(spark, DATA, "documents"), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and len(least) < len(docs)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["slot", "shard", "byte_at", "n_tokens", "doc_ids", "sha1"] and out.count() > 50


def test_registered():
    import __spark_entry__
    from siftwell.llm import registry

    found = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in found)] == [] and "pipeline" in found
    assert set(registry.QUERIES) <= set(found)
