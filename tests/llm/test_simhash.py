import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import common, simhash, vptree
from siftwell.llm.common import Forest, components, possible, table
from tests.llm.helpers import documents, empty, prose, rows


def plain(text, words=3):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    sh = [b" ".join(own[k : k + words]) for k in range(len(own) - words + 1)] or [b" ".join(own)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, radius=3):
    f = Forest(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                f.join(np.array([i]), np.array([j]))
    least = {}
    for r, d in zip(f.root, ids):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(r) for r in f.root]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    long = prose(rng, 800)
    near = [(200 + k, long.replace(" ", f" x{k} ", 1), "en", "a", 0) for k in range(12)]
    data = rows() + near + [(300, "One  TWO\tÉté", "", "", 0), (301, "one two Été", "", "", 0), (302, "one two été", "", "", 0), (303, "word", "", "", 0)]
    got = sorted(simhash.simhash_components(documents(spark, data)).collect(), key=str)
    fps = [plain(r[1]) for r in data]
    want = sorted(zip((r[0] for r in data), (x - (1 << 64) if x >> 63 else x for x in fps), brute(fps, [r[0] for r in data])), key=str)
    assert [tuple(r) for r in got] == [tuple(x) for x in map(tuple, want)] or sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({r.component_id for r in got if r.doc_id is not None and 200 <= r.doc_id < 212}) < 12


def test_empty_table(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_trees_miss_no_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))  # a group within two bits
    flips = [base[:300] ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64) for _ in range(radius)])]
    fps = np.unique(np.concatenate([base, dense, *flips]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)) if i < j}
    got = set()
    for half in (0, 1):
        tree = vptree.build(fps[::3], half, radius, 32, seed=half)
        homes = np.zeros(len(fps), int)
        for leaf, home, visit in vptree.route(tree, fps):
            homes[home] += 1
            members = np.concatenate([home, visit])
            for i, j in vptree.pairs(fps[home], fps[members], half, radius):
                got |= {(min(a, b), max(a, b)) for a, b in zip(home[i], members[j]) if a != b}
        assert (homes == 1).all()
    assert got == want


def test_grid_finds_what_whole_leaves_find(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    test_components_equal_brute_force(spark)


def test_near_copies_go_and_distinct_texts_stay(spark):
    rng = random.Random(9)
    base = [prose(rng, 300) for _ in range(25)]
    edited = [t.replace(t.split()[40], "changed", 1) for t in base[:10]]
    data = [(k, t, "en", "a", 0) for k, t in enumerate(base)] + [(100 + k, t, "en", "a", 0) for k, t in enumerate(edited)] + [(200, base[20], "", "", 0), (None, "x", "", "", 0), (None, "x", "", "", 0), (300, None, "", "", 0), (301, "", "", "", 0)]
    docs = documents(spark, data)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(25), 300, None], key=str)


def test_implied_splits_miss_no_pair():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([base := rng.integers(0, 1 << 63, 2000, dtype=np.uint64), base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)) if i < j}
    got = set()
    for half in (0, 1):
        leaves = [(home, visit) for _, home, visit in vptree.route(vptree.build(fps[::9], half, 3, 8, seed=1), fps, 3, half, 3)]
        assert sorted(np.concatenate([h for h, _ in leaves]).tolist()) == list(range(len(fps))) and len(leaves) > 32
        for home, visit in leaves:
            members = np.concatenate([home, visit])
            for i, j in vptree.pairs(fps[home], fps[members], half, 3):
                got |= {(min(a, b), max(a, b)) for a, b in zip(home[i], members[j]) if a != b}
    assert got == want


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    data = [(7, a, "", "", 0), (7, b, "", "", 0), (7, a, "", "", 0), (9, a + " more", "", "", 0), (None, b, "", "", 0), (None, prose(rng, 30), "", "", 0)]
    kept = simhash.drop_near_duplicates(documents(spark, data)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7, a), (7, b), (None, data[5][1])], key=str)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_near_links_at_every_size(similarity):
    # Pairs just at a similarity meet in a table as often as stated, with tables as for 10 ** 4 to 10 ** 9 documents.
    rng = np.random.default_rng(1)
    share = float(np.arccos(2 * 0.8 / 1.8) / np.pi)
    shingles = 400
    cut = int(np.ceil(similarity * shingles))
    sets = [rng.integers(0, 1 << 63, shingles, dtype=np.uint64) for _ in range(400)]
    words = lambda h: [simhash.majority(h), *(simhash.majority(simhash.mixed(h, m)) for m in simhash.MIXERS)]
    a, b = (np.array([words(h[:k]) for h in sets], np.uint64) for k in (shingles, cut))
    for n in (10**4, 10**6, 10**9):
        shard, rest, tables = simhash.key_tables(n, share)
        picks = np.random.default_rng(4)
        met = np.zeros(len(sets), bool)
        for _ in range(tables):
            at = picks.permutation(256)[: shard + rest]
            x = simhash.key_of(a, at) ^ simhash.key_of(b, at)
            met |= (x & np.uint64((1 << shard) - 1) == 0) & (np.bitwise_count(x) <= 1)
        assert met.mean() >= 0.97, (n, shard, rest, tables, met.mean())


@pytest.mark.parametrize("leaf,block", [(65_536, 131_072), (64, 131_072), (64, 16)])
def test_near_links_connect_what_brute_force_does(spark, monkeypatch, leaf, block):
    # Shards, blocks and skipped buckets lose no candidate but those that no table holds.
    monkeypatch.setattr(simhash, "NEAR_LEAF_ROWS", leaf)
    monkeypatch.setattr(simhash, "NEAR_BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (150, 4), dtype=np.uint64)
    near = base[:100].copy()
    for row in near:
        for bit in rng.permutation(256)[:20]:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    dense = np.repeat(base[:1], 200, axis=0)
    for row in dense:
        for bit in rng.permutation(256)[:12]:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    words = np.concatenate([base, near, dense])
    nodes = spark.createDataFrame([(k, *map(int, w.view(np.int64)), 100) for k, w in enumerate(words)], simhash.NODE)
    edges = simhash.near_links(nodes, 0.8, 60, 0.1515).collect()
    got, want = Forest(len(words)), Forest(len(words))
    got.join(np.array([e.a for e in edges]), np.array([e.b for e in edges]))
    want.join(*np.nonzero(np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= 60))
    assert np.mean(got.root == want.root) >= 0.99
    assert all(np.bitwise_count(words[e.a] ^ words[e.b]).sum() <= 60 or got.root[e.a] == got.root[e.b] for e in edges)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    fps = [plain(t) for t in docs.values()]
    want = {(k, f"{f:016x}", c) for k, f, c in zip(docs, fps, brute(fps, list(docs)))}
    assert {tuple(r) for r in simhash.op4_simhash(spark, d).collect()} == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 4)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k != v} == {**{k: 100 for k in range(101, 161)}, **{k: 7 for k in range(200, 260)}}


def jaccard(a, b, words=5):
    x, y = ({tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("rows_a_block", [1024, 9])
def test_links_are_decided_by_exact_similarity(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(simhash, "CHECK_ROWS", rows_a_block)
    rng = random.Random(11)
    data, want = [], []
    for k in range(150):  # pairs just above and just below 0.8: all of the first go, none of the second
        text = prose(rng, 104)
        words = text.split()
        cut = 80 + rng.randint(0, 8)  # a shorter copy: (cut - 4) of 100 shingles
        other = " ".join(words[:cut])
        data += [(2 * k, text, "en", "a", 0), (2 * k + 1, other, "en", "a", 0)]
        want += [2 * k] + ([2 * k + 1] if jaccard(text, other) < 0.8 else [])
    assert 150 < len(want) < 299
    kept = simhash.drop_near_duplicates(documents(spark, data))
    assert sorted(r.doc_id for r in kept.collect()) == want


def shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_partners_are_not_shuffled(spark):
    rng = random.Random(5)
    base = [" ".join(f"{rng.getrandbits(64):016x}" for _ in range(300)) for _ in range(600)]
    data = [(k, t, "en", "a", 0) for k, t in enumerate(base)] + [(1000 + k, t + " more", "en", "a", 0) for k, t in enumerate(base[:5])] + [(9, base[9], "en", "a", 0)]
    path = common.shared_dir(spark, "shuffle-test")
    documents(spark, data).write.parquet(path)
    before = shuffled(spark)
    kept = simhash.drop_near_duplicates(spark.read.parquet(path)).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == list(enumerate(base))
    assert shuffled(spark) - before < sum(map(len, base)) / 4


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15, 1 << 6])
def test_possible_rows_hold_all_that_are_wanted(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MARK_BITS", bits)
    monkeypatch.setattr(common, "MARK_ROW", min(bits, 1 << 15))
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) AS id", "cast(id % 3 AS string) AS t")
    wanted = rows.where("id IS NULL OR id % 11 = 0").withColumnsRenamed({"id": "a", "t": "b"})
    got = possible(rows, [F.col("id"), F.col("t")], wanted, [F.col("a"), F.col("b")], "may").collect()
    assert len(got) == 20_000 and all(r.may for r in got if r.id is None or r.id % 11 == 0)
    assert bits < 1 << 25 or sum(r.may for r in got) < 20_000 * (1 / 11 + 1 / 16)
    none = possible(rows, [F.col("id"), F.col("t")], wanted.limit(0), [F.col("a"), F.col("b")], "may")
    assert none.where("may").count() == 0 and none.count() == 20_000


def test_comparing_a_dense_group_takes_bounded_memory():
    rng = np.random.default_rng(3)
    n = 1024
    col = {"root": np.zeros(n, np.int64), "part": np.arange(n), "at": np.arange(n), "n": np.full(n, 100), "bits": rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)}
    every, sets = np.arange(n), [np.zeros(0, "<u8")] * n
    tracemalloc.start()
    simhash.compared(col, sets, every, every, True, 0.8, 60)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90e6, most
