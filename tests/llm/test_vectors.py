import duckdb
import numpy as np
import pytest

from siftwell.llm import vectors
from siftwell.llm.common import Forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def data():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 24))
    out = []
    for k, v in enumerate(base):
        out.append((k, v.tolist(), k % 3))
        if k % 4 == 0:
            out.append((1000 + k, (v + 0.05 * rng.normal(size=24)).tolist(), k % 3))
        if k % 6 == 0:
            out.append((2000 + k, (v * 3).tolist(), k % 3))
            out.append((3000 + k, v.tolist(), (k + 1) % 3))
            out.append((4000 + k, v.tolist(), k % 3))
    dense = base[0] + 0.08 * rng.normal(size=(150, 24))
    return out + [(5000 + k, v.tolist(), 0) for k, v in enumerate(dense)]


def brute(rows):
    x = np.array([np.float32(r[1]) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    f = Forest(len(rows))
    f.join(*np.nonzero(near))
    ids = np.array([r[0] for r in rows])
    return {r[0]: (int(n) - 1, int(ids[f.root == c].min())) for r, n, c in zip(rows, near.sum(1), f.root)}


def test_links_equal_brute_force(spark):
    rows = data()
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = brute(rows)
    links = sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got.values()) >= 0.98 * links
    assert all(got[k].n_links <= n for k, (n, _) in want.items())  # none below the bound
    assert np.mean([got[k].component_id == c for k, (_, c) in want.items()]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_count_each_pair_once(spark, monkeypatch):
    before = {r.vec_id: tuple(r) for r in vectors.near_vectors(spark.createDataFrame(data(), SCHEMA)).collect()}
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    assert {r.vec_id: tuple(r) for r in vectors.near_vectors(spark.createDataFrame(data(), SCHEMA)).collect()} == before


def test_awkward_vectors_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0] * 3, 0), (7, [1.0, None, 2.0], 0), (8, [1.0, float("nan"), 2.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [1.0, 2.0], 0), (11, [x * 1e-30 for x in v], 0), (12, [x * 1e30 for x in v], 0), (1, v, 0), (None, v, 0), (13, [-1.0, -2.0, -3.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    own = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert own[1] == (5, 1, True) and own[2] == (5, 1, False) and own[11] == own[12] == (5, 1, False) and own[None] == (5, 1, False)
    assert all(own[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 13))


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(7, a, 0), (7, b, 0), (8, [1.0, 0.01, 0.1], 0), (9, [0.01, 1.0, 0.1], 0), (5, a, 1), (5, b, 2), (6, b, 1), (6, b, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (6, 0, 6), (6, 1, 5), (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7)]


def test_doubles_beyond_floats_link(spark):
    rows = [(1, [1e300, 1.0], 0), (2, [1e200, 1.0], 0), (3, [1e-300, 0.0], 0), (4, [1.0, 1e300], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_extra_columns_and_text_labels(spark):
    from pyspark.sql import functions as F

    clash = ("node", "root", "least", "times", "sound", "slot", "dim", "id", "home", "vec", "n", "pack", "a", "b", "component_id", "n_links")
    df = spark.createDataFrame(data(), SCHEMA).withColumn("label", F.concat(F.lit("l"), "label"))
    got = {r.vec_id: tuple(r) for r in vectors.near_vectors(df.withColumns({c: F.lit("x") for c in clash})).collect()}
    assert got == {r.vec_id: tuple(r) for r in vectors.near_vectors(spark.createDataFrame(data(), SCHEMA)).collect()}


@pytest.mark.parametrize("spins", [1, 2, 3, 4])
def test_recall_at_every_number_of_rotations(spark, monkeypatch, spins):
    # Pairs at a cosine of 0.93 to 1 in 64 dimensions, as many rotations as 10 to 10 ** 9 vectors take.
    monkeypatch.setattr(vectors, "spins_of", lambda n, d: spins)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    y = x + rng.uniform(0, 0.45, (3000, 1)) * rng.normal(size=(3000, 64))
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    a, b = (vectors.codes(vectors.unit_rows(z), spins) for z in (x, y))
    met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    near = cos >= 0.93
    assert near.sum() > 1500 and met[near].mean() >= 0.98 and met[near & (cos < 0.94)].mean() >= 0.9


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(map(tuple, vectors.op2_near_vectors(spark, d).collect())) == sorted(con.sql(vectors.ORACLE).fetchall())


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
