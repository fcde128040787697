import os
import random

import numpy as np
import pytest

from siftwell.llm import tokens as t
from siftwell.llm.common import shared_dir, table
from tests.llm.helpers import documents, empty, prose, rows


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 70_001])
def test_permutation(n):
    p = t.Permutation(n, 5)
    y = p(np.arange(n))
    assert sorted(y.tolist()) == list(range(n))
    assert (p(y, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("length,shard", [(64, 16), (1024, 4)])
def test_round_trip(spark, length, shard):
    path = shared_dir(spark, "shards-test")
    got = sorted(t.write_shards(documents(spark), path, length=length, shard=shard).collect())
    n = len(got)
    assert [r.slot for r in got] == list(range(n)) and all(r.shard == r.slot // shard and r.byte_at == r.slot % shard * 2 * length for r in got)
    whole = t.read_slots(path, 0, n, length, shard)
    assert (t.read_slots(path, n // 2, n - n // 2, length, shard) == whole[n // 2 :]).all()  # resumed midway
    stream = whole[t.Permutation(n)(np.arange(n))].ravel()
    own = t.encoder(t.read_ranks(t.VOCABULARY))
    parts = np.split(stream, np.flatnonzero(stream == t.END) + 1)
    texts = sorted(own.decode(x[:-1].tolist()) for x in parts[: len(rows())])
    assert texts == sorted(r[1] or "" for r in rows())
    assert all(len(x) <= 1 for x in parts[len(rows()) :])  # only the fill is left
    assert sum(r.n_tokens for r in got) == sum(len(own.encode_ordinary(r[1] or "")) + 1 for r in rows())
    assert {d for r in got for d in r.doc_ids} == {r[0] for r in rows()}
    names = os.listdir(path.removeprefix("file://"))
    assert all(x.endswith(".bin") for x in names) and len(names) == -(-n // shard)
    sizes = [os.path.getsize(f"{path.removeprefix('file://')}/{x}") for x in sorted(names)]
    assert all(s == shard * 2 * length for s in sizes[:-1])


@pytest.mark.parametrize("n,window", [(1, 4), (10, 4), (1000, 64), (1000, None)])
def test_windows_keep_sequences_near(n, window):
    slots = t.Order(n, window)(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (np.array_equal(slots // window, np.arange(n) // window)) if window else True
    assert n < 100 or not np.array_equal(slots, np.arange(n))


def shards_of(spark, df, **options):
    path = shared_dir(spark, "shards-test")
    n = t.write_shards(df, path, length=64, shard=8, **options).count()
    return t.read_slots(path, 0, n, 64, 8)


def test_shards_do_not_depend_on_partitions(spark):
    one = shards_of(spark, documents(spark))
    assert np.array_equal(one, shards_of(spark, documents(spark).repartition(7)))


def test_shards_follow_the_order_of_files(spark):
    path = shared_dir(spark, "docs-test")
    rng = random.Random(1)
    data = [(k, f"{k} " + prose(rng, rng.randint(5, 60)), "en", "a", 0) for k in range(500)]
    documents(spark, data).orderBy("doc_id").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    own = t.encoder(t.read_ranks(t.VOCABULARY))
    stream = np.concatenate([np.append(own.encode_ordinary(r[1]), t.END) for r in data])
    found = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k" if size == "4k" else "4m")
        found.append(shards_of(spark, spark.read.parquet(path), window=16, files=True))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert np.array_equal(*found)
    n = len(found[0])
    assert np.array_equal(found[0][t.Order(n, 16)(np.arange(n))].ravel()[: len(stream)], stream)


def test_query_gives_every_token(spark):
    d = "/root/testdata/sf0.001"
    got = t.op8_tokens(spark, d).collect()
    docs = table(spark, d, "documents").collect()
    own = t.encoder(t.read_ranks(t.VOCABULARY))
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(r.n_tokens for r in got) == sum(len(own.encode_ordinary(r.text or "")) + 1 for r in docs)
    assert {x for r in got for x in r.doc_ids} == {r.doc_id for r in docs}


def test_empty_table(spark):
    assert t.write_shards(empty(spark), shared_dir(spark, "shards-test")).count() == 0
