"""Embedding near-duplicates (operator 2): cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from siftwell.llm.common import Forest, bucket_sizes, checkpointed, components_marked, dealt_rows, grid, spread, table, written

#: Buckets of a table that a vector looks into, and hash tables at least and for each rotation of a hash.
PROBES, TABLES, TABLES_A_SPIN = 4, 8, 4
#: Vectors for each bucket number of a table from which hashes join one rotation more, so that buckets don't fill up.
FILL = 4
COSINE = 0.93
#: Rows of a block of a bucket, rows of the buckets that a task takes together, and pairs that it compares at once.
BLOCK_ROWS, PACK_ROWS, PAIRS = 2_048, 16_384, 1 << 16


def spins_of(n: int, d: int) -> int:
    """Rotations that a hash joins among ``n`` vectors of length ``d``: the least with n / FILL bucket numbers."""
    vertices, spins = 2 << max(0, d - 1).bit_length(), 1
    while FILL * vertices**spins < n:
        spins += 1
    return spins


def tables_of(spins: int) -> int:
    return max(TABLES, TABLES_A_SPIN * spins)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, whose length is a power of two, by butterflies."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray, spins: int, seed: int = 2) -> np.ndarray:
    """Bucket numbers (rows, tables, PROBES) of 32 bits of unit vectors, the first of each table the vector's own.

    A rotation is three rounds of random signs and a Hadamard transform; its hash is the coordinate of
    largest magnitude with its sign. A bucket joins ``spins`` hashes; the further probes replace the hashes by the
    next-likely vertices with the least loss of magnitude.
    """
    d = 1 << max(0, unit.shape[1] - 1).bit_length()
    padded = np.zeros((len(unit), d))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, d])
    out = np.zeros((len(unit), tables_of(spins), PROBES), np.int64)
    keep = min(PROBES, d)
    for t in range(out.shape[1]):
        name, loss = np.zeros((len(unit), 1), np.uint64), np.zeros((len(unit), 1))
        for _ in range(spins):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], d))
            top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :keep]
            value = np.take_along_axis(x, top, axis=1)
            vertex = (top * 2 + (value < 0)).astype(np.uint64)
            name = (name[:, :, None] * np.uint64(2 * d) + vertex[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + (np.abs(value[:, :1]) - np.abs(value))[:, None, :]).reshape(len(unit), -1)
            # Only the best PROBES combinations so far can be among the best in the end.
            first = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
            name, loss = np.take_along_axis(name, first, axis=1), np.take_along_axis(loss, first, axis=1)
        found = ((name + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def unit_rows(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    # Scaling by the largest component first keeps very large and very small vectors from over- or underflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def postings(vectors: DataFrame, n: int) -> DataFrame:
    """(label, dim, slot, id, home, times, vec, codes) for each bucket that each of ``n`` vectors looks into; home in its own.

    slot is the table's number above the 32 bits of the bucket's.
    """
    kind, told = (vectors.schema[c].dataType for c in ("embedding", "label"))
    arrow_kind, arrow_label = to_arrow_type(kind), to_arrow_type(told)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                vec, label, node, times = (batch.column(k) for k in range(4))
                sizes = np.array([len(v) for v in vec])
                for d in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == d)
                    code = codes(unit_rows(vec.take(pa.array(rows)).to_pylist()), spins_of(n, d))
                    slot = code + (np.arange(code.shape[1]) << 32)[None, :, None]
                    new = np.ones(code.shape, bool)
                    for p in range(1, PROBES):
                        new[:, :, p] = (code[:, :, p : p + 1] != code[:, :, :p]).all(2)
                    i, t, p = np.nonzero(new)
                    at_row = pa.array(rows[i])
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(code.astype(np.uint32).view(np.int32).ravel()), code[0].size).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([
                        label.take(at_row), pa.array(np.full(len(i), d, np.int32)), pa.array(slot[i, t, p]), node.take(at_row),
                        pa.array(p == 0), times.take(at_row), vec.take(at_row).cast(arrow_kind), flat.take(pa.array(i)),
                    ], ["label", "dim", "slot", "id", "home", "times", "vec", "codes"])

    schema = f"label {told.simpleString()}, dim int, slot long, id long, home boolean, times long, vec {kind.simpleString()}, codes array<int>"
    return vectors.select("embedding", "label", "node", "times").mapInArrow(run, schema)


def candidates(bucket: np.ndarray, as_home: np.ndarray, ids: np.ndarray, at_home: np.ndarray, x: np.ndarray, cosine: float):
    """Yields arrays (i, j) of rows of one bucket, i in a home role and j as a member, whose vectors link.

    Rows are sorted by bucket. Small buckets' pairs are laid out for all buckets at once, large buckets' blocks
    multiplied as matrices.
    """
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    number = np.repeat(np.arange(len(starts)), sizes)
    members = np.flatnonzero(~as_home)
    first = np.searchsorted(members, starts)
    many = np.searchsorted(members, starts + sizes) - first
    homes = np.flatnonzero(as_home)
    homes = homes[many[number[homes]] > 0]

    def sifted(i, j):
        # Both at home: each pair is seen from both sides; one at home: from that side.
        good = (ids[i] != ids[j]) & (~at_home[j] | (ids[i] < ids[j]))
        i, j = i[good], j[good]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        return i[near], j[near]

    large = many[number[homes]] > 256
    for b in np.unique(number[homes[large]]):
        own, others = homes[number[homes] == b], members[first[b] : first[b] + many[b]]
        for at in range(0, len(own), 256):
            i, j = np.nonzero(x[own[at : at + 256]] @ x[others].T >= cosine - 1e-9)
            for k in range(0, len(i), PAIRS):
                yield sifted(own[at + i[k : k + PAIRS]], others[j[k : k + PAIRS]])
    small = homes[~large]
    n = many[number[small]]
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + PAIRS, PAIRS))
    for a, b in zip(cuts, cuts[1:]):
        own, k = small[a:b], n[a:b]
        if len(own):
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yield sifted(np.repeat(own, k), members[np.repeat(first[number[own]], k) + inner])


def first_met(i: np.ndarray, j: np.ndarray, code: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether a pair's bucket is the first in which it meets: of the lowest table, there of the lowest number, in
    which one of the two is at home. So a pair that meets in several buckets counts once."""
    table_of, own = slot[i] >> 32, slot[i] & ((1 << 32) - 1)
    ca, cb = code[i], code[j]
    in_b, in_a = (cb == ca[:, :, :1]).any(2), (ca == cb[:, :, :1]).any(2)  # is a's own bucket one of b's, and so on
    first = (in_b | in_a).argmax(1) == table_of
    k = np.arange(len(i))
    low = np.minimum(np.where(in_b[k, table_of], ca[k, table_of, 0], 1 << 60), np.where(in_a[k, table_of], cb[k, table_of, 0], 1 << 60))
    return first & (low == own)


def links(vectors: DataFrame, cosine: float) -> DataFrame:
    """(node, n, root): counts of each node's links that a task found, and a root it is linked to within the task."""
    total = vectors.count()

    def run(key, group):  # no annotations: Spark would read them
        group = group.combine_chunks().sort_by([(c, "ascending") for c in ("label", "slot", "hb", "mb")])
        col = {c: group.column(c).to_numpy() for c in ("slot", "hb", "mb", "id", "home", "times", "as_home")}
        flat = lambda c: group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = len(col["id"])
        x = unit_rows(flat("vec").reshape(n, -1))
        code = flat("codes").view(np.uint32).reshape(n, -1, PROBES).astype(np.int64)
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        changes = np.zeros(n, bool)
        for c in (label, col["slot"], col["hb"], col["mb"]):
            changes[1:] |= c[1:] != c[:-1]
        own, place = np.unique(col["id"], return_inverse=True)
        count, forest = np.zeros(len(own), np.int64), Forest(len(own))
        for i, j in candidates(np.cumsum(changes), col["as_home"], col["id"], col["home"], x, cosine):
            good = first_met(i, j, code, col["slot"])
            i, j = i[good], j[good]
            np.add.at(count, place[i], col["times"][j])
            np.add.at(count, place[j], col["times"][i])
            forest.join(place[i], place[j])
        hit = np.flatnonzero(count)
        return pa.table({"node": own[hit], "n": count[hit], "root": own[forest.root[hit]]})

    keys = ["label", "dim", "slot"]
    rows = postings(vectors, total)
    sizes = bucket_sizes(rows, keys)
    dealt = grid(rows, keys, BLOCK_ROWS, sizes).select(*keys, "hb", "mb", "id", "home", "times", "vec", "codes", "as_home")
    pack = F.pmod(F.xxhash64(*keys, "hb", "mb"), F.lit(max(1, dealt_rows(sizes, BLOCK_ROWS) // PACK_ROWS)))
    return dealt.withColumn("pack", pack).groupBy("dim", "pack").applyInArrow(run, "node long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors of one length and label link if their cosine in double precision is at least ``cosine``. Equal
    vectors of a label collapse to one node before hashing and count with their number; ids play no part in linking,
    so rows that repeat an id with another label or vector have links and a component of their own. A vector that is
    null, empty or zero or holds null, NaN or an infinity, and one without a label, links with nothing. n_links counts
    other rows linked directly, repeated rows included; component_id is the smallest vec_id reachable, itself included;
    kept is whether that is the row's own. Rows without vec_id count as links and have their component's smallest id,
    null if it has none. Vectors may be of any length, and of several in one table; an empty table gives no rows; other
    columns are ignored, whatever their names. Candidates share a bucket of cross-polytope tables, of which each vector
    probes PROBES; the number of rotations in a hash follows the number of vectors. Every candidate is verified, pairs
    that share none are missed (see the README for the recall).
    """
    whole = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(whole, ArrayType) and isinstance(whole.elementType, FloatType) else "double"
    x = F.col("embedding").cast(f"array<{kind}>")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select("vec_id", x.alias("embedding"), "label", F.coalesce(sound, F.lit(False)).alias("sound"))
    groups = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    groups = spread(written(groups.withColumn("node", F.monotonically_increasing_id()), "vectors"))
    found = checkpointed(links(groups, cosine))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    rooted = components_marked(found.select(F.col("node").alias("a"), F.col("root").alias("b")), groups, "node")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "node", "left").select("label", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    named = checkpointed(named)
    linked = rows.where("sound").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Ids are unique in the table. The recursion walks links from every vector.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id
"""
