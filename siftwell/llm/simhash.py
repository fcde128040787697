"""SimHash near-duplicates (operator 4): fingerprints linked exactly through sharded vantage-point trees."""

from __future__ import annotations

from functools import partial
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import vptree
from siftwell.llm.common import Forest, bucket_sizes, checkpointed, components, components_marked, grid, map_arrow, possible, smallest, spread, table, written

#: Fingerprints that vantage points are chosen from at most, and leaves of a fitted tree; beyond them leaves go on by
#: implied points.
SAMPLE, LEAVES = 32_768, 4_096
#: Fingerprints at home in a leaf that the trees of ``links`` and of ``near_links`` aim at, and rows of a block of a task.
LEAF_ROWS, NEAR_LEAF_ROWS, BLOCK_ROWS, NEAR_BLOCK_ROWS = 1_024, 65_536, 8_192, 131_072
#: Share of the pairs at the bound that all tables of ``near_links`` may miss, and chance partners of a node in a table.
MISS, CROWD = 0.0005, 256
#: Odd multipliers from which a shingle's further 64-bit hashes are mixed.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
NODE = "node long, fp long, v1 long, v2 long, v3 long, n long"
#: Candidates of a task's pack, rows and shingles of its blocks, candidates of a component that meet all of its blocks, and
#: pairs that are compared before joined ones are left out.
PACK_ROWS, CHECK_ROWS, CHECK_SHINGLES, PIVOTS, CHECK_PAIRS = 512, 1_024, 1 << 21, 32, 256
#: Pairs of one bucket that are laid out at once, and those whose 256 bits are.
PAIRS, BIT_PAIRS = 1 << 20, 1 << 15
#: Standard deviations over the expected distance of 256 bits up to which a pair is a candidate.
SPREAD = 6.0


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(own[k:] for k in range(words)))) if len(own) >= words else [b" ".join(own)]
    return np.array(list(map(partial(xxhash.xxh64_intdigest, seed=seed), parts)), dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The 64 bits, as an unsigned integer, that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # so a byte holds each sum
        counts += np.add.reduce(np.unpackbits(h[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int, seed: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer.

    A-Z are lower-cased, words are split at ASCII white space, shingles have ``words`` words (a shorter text is one
    shingle, one without words has fingerprint zero) and count as often as they occur. A bit is set if it is set in
    over half of the shingles' XXH64.
    """
    return majority(shingle_hashes(text, words, seed))


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(29))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def with_fingerprint(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Whole texts; null counts as empty."""

    def rows(x: dict) -> dict:
        return {"doc_id": x["doc_id"], "fp": np.array([fingerprint(t, words, seed) for t in x["text"]], np.uint64).view(np.int64)}

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), rows, "doc_id long, fp long")


def with_wide_fingerprint(docs: DataFrame, words: int, seed: int, passed: str = "doc_id long", shingles: bool = False) -> DataFrame:
    """(passed, fp, v1, v2, v3, n): 256 bits over the distinct shingles, and their number n.

    The columns declared in ``passed`` pass through; with ``shingles`` the sorted distinct hashes come as well.
    """
    kept = [c.split()[0] for c in passed.split(", ")]

    def rows(x: dict) -> dict:
        out: dict = {**{c: x[c] for c in kept}, "fp": [], "v1": [], "v2": [], "v3": [], "n": [], **({"shingles": []} if shingles else {})}
        for t in x["text"]:
            h = np.unique(shingle_hashes(t, words, seed))
            for c, of in (("fp", h), *((f"v{k + 1}", mixed(h, m)) for k, m in enumerate(MIXERS))):
                out[c].append(majority(of))
            out["n"].append(len(h))
            if shingles:
                out["shingles"].append(h.tobytes())
        return {k: np.array(v, np.uint64).view(np.int64) if k in ("fp", "v1", "v2", "v3") else v for k, v in out.items()}

    schema = ", ".join([passed, *(f"{c} long" for c in ["fp", "v1", "v2", "v3", "n"])]) + (", shingles binary" if shingles else "")
    return map_arrow(docs.select(*kept, F.col("text").cast("binary").alias("text")), rows, schema)


def fitted_leaves(n: int, leaf_rows: int) -> tuple[int, int]:
    """(leaves of a fitted tree, times that each is split again) for about ``leaf_rows`` of ``n`` fingerprints in a leaf."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    return 1 << min(depth, LEAVES.bit_length() - 1), max(0, depth - LEAVES.bit_length() + 1)


def sampled(nodes: DataFrame, columns: list[str]) -> np.ndarray:
    """(rows, columns) of at most SAMPLE nodes as unsigned words."""
    found = smallest(nodes.select("node", *columns), "node", SAMPLE).select(*columns).collect()
    return np.array([tuple(r) for r in found], np.int64).reshape(-1, len(columns)).view(np.uint64)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between ``node`` values that connect all nodes whose fp lie within ``radius`` bits.

    Nothing is missed: the vantage points come from a bounded sample and only steer the work. Edges are a spanning
    forest of the links that each task finds, so a dense group of m near copies gives about m edges a task.
    """
    leaves, more = fitted_leaves(nodes.count(), LEAF_ROWS)
    sample = sampled(nodes, ["fp"])[:, 0]
    trees = [vptree.build(sample, half, radius, leaves, seed=half) for half in (0, 1)]

    def routed(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for half, tree in enumerate(trees):
                for leaf, home, visit in vptree.route(tree, fps, more, half, radius):
                    x = batch.take(pa.array(np.concatenate([home, visit])))
                    k = x.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, half, np.int32)), pa.array(np.full(k, leaf, np.int64)), pa.array(np.arange(k) < len(home)), *x.columns], ["half", "leaf", "home", "id", "fp"])

    def linked(key, group):  # no annotations: Spark would read them
        col = {c: group.column(c).to_numpy() for c in ("id", "fp", "as_home")}
        own, at = np.unique(col["id"], return_inverse=True)
        homes, members, forest = np.flatnonzero(col["as_home"]), np.flatnonzero(~col["as_home"]), Forest(len(own))
        fp = col["fp"].view(np.uint64)
        for i, j in vptree.pairs(fp[homes], fp[members], key[0].as_py(), radius):
            forest.join(at[homes[i]], at[members[j]])
        moved = np.flatnonzero(forest.root != np.arange(len(own)))
        return pa.table({"a": own[moved], "b": own[forest.root[moved]]})

    rows = nodes.select("node", "fp").mapInArrow(routed, "half int, leaf long, home boolean, id long, fp long")
    keys = ["half", "leaf"]
    dealt = grid(rows, keys, BLOCK_ROWS, bucket_sizes(rows, keys)).drop("home")
    return dealt.groupBy(*keys, "hb", "mb").applyInArrow(linked, "a long, b long")


def chances(n: int, p: float) -> np.ndarray:
    """The binomial law of ``n`` trials."""
    k = np.arange(n + 1)
    log = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in k]) + k * np.log(p) + (n - k) * np.log1p(-p)
    return np.exp(log)


def key_tables(n: int, share: float) -> tuple[int, int, int]:
    """(shard bits, other bits of a key, tables) for ``n`` nodes and a pair whose 256 bits differ by ``share`` each.

    Partners in a table have equal shard bits and differ in one other bit at most. Shard bits are as many as the leaves
    of a table's tree need; a key is long enough that a node has about CROWD chance partners in a table; tables are as
    many as it takes for a share MISS of such pairs at most to be no partners in all of them.
    """
    leaves, more = fitted_leaves(n, NEAR_LEAF_ROWS)
    depth = leaves.bit_length() - 1 + more
    shard = depth + 2 if depth else 0
    rest = next(b for b in range(4, 64 - shard) if n * (b + 1) <= CROWD << (shard + b))
    bits = shard + rest
    pick = lambda of, k: lgamma(of + 1) - lgamma(k + 1) - lgamma(of - k + 1)
    differ = lambda d, k: np.exp(pick(d, k) + pick(256 - d, bits - k) - pick(256, bits)) if k <= d and bits - k <= 256 - d else 0.0
    close = np.array([differ(d, 0) + differ(d, 1) * rest / bits for d in range(257)])
    law, tables = chances(256, share), 1
    while law @ (1 - np.minimum(1, close)) ** tables > MISS:
        tables += 1
    return shard, rest, tables


def key_of(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Keys made of the bits at ``positions`` of each row's 256 (four words)."""
    out = np.zeros(len(words), np.uint64)
    for k, at in enumerate(positions.tolist()):
        out |= (words[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)) << np.uint64(k)
    return out


def bits_apart(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the rows ``i`` and ``j`` of ``bits`` differ; a bounded number of them is laid out at once."""
    out = np.empty(len(i), np.int32)
    for at in range(0, len(i), BIT_PAIRS):
        k = slice(at, at + BIT_PAIRS)
        out[k] = np.bitwise_count(bits[i[k]] ^ bits[j[k]]).sum(1, dtype=np.int32)
    return out


def near_links(nodes: DataFrame, similarity: float, wide: int, share: float) -> DataFrame:
    """Candidate edges (a, b) that connect nodes whose 256 bits lie within ``wide`` and whose shingle counts n allow
    ``similarity``, as far as they are partners in some table (see ``key_tables``).

    Each table has a vantage-point tree over the shard bits of its keys. Partners differ in none of these, so the triangle
    bounds leave one shard for each node, and copies of its row don't grow with the table. Within a shard, sorted keys
    are looked up with each other bit flipped. Edges are a spanning forest of what each task finds; members of a
    bucket that are connected already aren't compared again. A large shard is dealt into blocks that meet one another.
    """
    n = nodes.count()
    (leaves, more), (shard, rest, tables) = fitted_leaves(n, NEAR_LEAF_ROWS), key_tables(n, share)
    low = np.uint64((1 << shard) - 1)
    rng = np.random.default_rng(4)
    positions = [rng.permutation(256)[: shard + rest] for _ in range(tables)]
    words = ["fp", "v1", "v2", "v3"]
    sample = sampled(nodes, words)
    trees = [vptree.build(key_of(sample, at) & low, None, 0, leaves, seed=t) for t, at in enumerate(positions)]

    def routed(batches):
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
            for t, (tree, at) in enumerate(zip(trees, positions)):
                keys = key_of(own, at)
                for leaf, home, _ in vptree.route(tree, keys & low, more, None, 0, shard):
                    x, k = batch.take(pa.array(home)), len(home)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, t, np.int32)), pa.array(np.full(k, leaf, np.int64)), pa.array(keys[home].view(np.int64)), *x.columns], ["tree", "leaf", "key", "id", *words, "n"])

    def linked(key, group):  # no annotations: Spark would read them
        group = group.combine_chunks().sort_by([("key", "ascending"), ("fp", "ascending")])
        col = {c: group.column(c).to_numpy() for c in ("id", "key", "n", "own")}
        bits_of = np.stack([group.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
        order = np.argsort(col["id"], kind="stable")
        own, at = col["id"][order], np.argsort(order, kind="stable")
        forest, within = Forest(len(own)), key[2].as_py() == key[3].as_py()
        homes = np.flatnonzero(col["own"] == key[2].as_py())
        members = homes if within else np.flatnonzero(col["own"] == key[3].as_py())

        def tried(i, j):
            open_ = forest.root[at[i]] != forest.root[at[j]]
            i, j = i[open_], j[open_]
            small, large = np.minimum(col["n"][i], col["n"][j]), np.maximum(col["n"][i], col["n"][j])
            good = (small >= similarity * large - 1e-9) & (bits_apart(bits_of, i, j) <= wide)
            forest.join(at[i[good]], at[j[good]])

        every = np.arange(len(own))
        for step in (1, 2, 3, 5, 8, 13):  # neighbours in order first: they connect most of a dense bucket
            tried(every[:-step], every[step:])
        mine, theirs = (col["key"][x].view(np.uint64) for x in (homes, members))
        for flip in [0, *(1 << k for k in range(shard, shard + rest))]:
            wanted = mine ^ np.uint64(flip)
            first = np.searchsorted(theirs, wanted, "left")
            many = np.searchsorted(theirs, wanted, "right") - first
            if within:
                many[(wanted < mine)] = 0  # each pair of buckets once
            some = np.flatnonzero(many)
            if len(some):
                # A bucket of members in one component is skipped by homes of that component.
                root = forest.root[at[members]]
                cuts = np.stack([first[some], first[some] + many[some]], axis=1).ravel()
                least, most = (f.reduceat(np.append(root, root[-1]), cuts)[::2] for f in (np.minimum, np.maximum))
                some = some[(least != most) | (least != forest.root[at[homes[some]]])]
            size = many[some]
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + PAIRS, PAIRS))
            for a, b in zip(cuts, [*cuts[1:], len(some)]):
                one, k = some[a:b], size[a:b]
                if len(one):
                    inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    tried(np.repeat(homes[one], k), members[np.repeat(first[one], k) + inner])
        moved = np.flatnonzero(forest.root != np.arange(len(own)))
        return pa.table({"a": own[moved], "b": own[forest.root[moved]]})

    rows = nodes.select("node", *words, "n").mapInArrow(routed, "tree int, leaf long, key long, " + NODE.replace("node", "id"))
    keys = ["tree", "leaf"]
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    blocks = F.ceil(F.col("_n") / NEAR_BLOCK_ROWS).cast("int")
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("id", F.lit(4)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key", "id", *words, "n")
    return dealt.groupBy(*keys, "low", "high").applyInArrow(linked, "a long, b long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``similarity``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def compared(col: dict, sets: list[np.ndarray], homes: np.ndarray, members: np.ndarray, once: bool, similarity: float, wide: int) -> Forest:
    """A forest over the rows' numbers ``at``, in which those that link are joined.

    Pairs of ``homes`` and ``members`` of one candidate component but not of one ``part`` are compared, nearest first;
    those that are connected already are left out. ``once`` takes each pair of rows that are both from one side.
    """
    forest, pairs = Forest(int(col["at"].max()) + 1 if len(col["at"]) else 0), []
    step = max(1, (1 << 20) // max(1, len(members)))
    for k in range(0, len(homes), step):
        own = homes[k : k + step]
        i, j = np.nonzero((col["root"][own, None] == col["root"][None, members]) & (col["part"][own, None] != col["part"][None, members]))
        i, j = own[i], members[j]
        small, large = np.minimum(col["n"][i], col["n"][j]), np.maximum(col["n"][i], col["n"][j])
        apart = bits_apart(col["bits"], i, j)
        good = (small >= similarity * large - 1e-9) & (apart <= wide) & ((i < j) | (not once))
        pairs.append(np.stack([apart[good], i[good], j[good]]))
    apart, i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
    order = np.argsort(apart, kind="stable")
    i, j, at = i[order], j[order], col["at"]
    while len(i):
        open_ = forest.root[at[i]] != forest.root[at[j]]
        i, j = i[open_], j[open_]
        x, y = i[:CHECK_PAIRS], j[:CHECK_PAIRS]
        good = np.array([alike(sets[a], sets[b], similarity) for a, b in zip(x, y)], bool)
        forest.join(at[x[good]], at[y[good]])
        i, j = i[CHECK_PAIRS:], j[CHECK_PAIRS:]
    return forest


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, seed: int, similarity: float, wide: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``candidates`` whose shingle sets have a Jaccard of ``similarity`` or more.

    ``nodes`` names each node's document by doc_id and text_hash. Only documents of candidate components have their
    shingles made again, once. Components are packed by hash, a large one in a pack of its own, and a large pack is
    dealt into blocks. First each block compares its own rows and about PIVOTS rows of each component, which connects
    dense groups; then only rows outside of their component's largest part meet the other blocks. Pairs within
    ``wide`` of 256 bits are compared by their exact shingle hashes.
    """
    found = components(candidates)
    members = checkpointed(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
    of_root = members.groupBy("root").agg(F.count("*").alias("_rows"))
    few = F.pmod(F.xxhash64("root"), F.lit(max(1, members.count() // PACK_ROWS)))
    members = members.join(of_root, "root").withColumn("pack", F.when(F.col("_rows") > PACK_ROWS, F.xxhash64("root", F.lit(1))).otherwise(few))
    members = members.join(nodes.select("node", "n", "doc_id", "text_hash"), "node")
    size = members.groupBy("pack").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / CHECK_ROWS), F.ceil(F.col("shingles") / CHECK_SHINGLES)).cast("long")
    members = members.join(size, "pack").select(
        "node", "root", "pack", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(5)), blocks).alias("own"), (F.pmod(F.xxhash64("node", F.lit(9)), F.col("_rows")) < PIVOTS).cast("long").alias("pivot"),
        F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"),
    )
    members = checkpointed(members)
    texts = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    texts = possible(texts, [F.col("doc_id").cast("long"), F.col("text_hash")], members, [F.col("__near_id"), F.col("__near_hash")], "__near_may").where("__near_may")
    named = texts.join(members, F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("text_hash") == F.col("__near_hash")))
    named = with_wide_fingerprint(named, words, seed, "node long, root long, pack long, blocks long, own long, pivot long", shingles=True)
    rows = written(named.dropDuplicates(["node"]), "candidates")

    def columns(group) -> tuple[dict, list[np.ndarray]]:
        col = {c: group.column(c).to_numpy() for c in ("node", "root", "part", "n")}
        col["bits"] = np.stack([group.column(c).to_numpy().view(np.uint64) for c in ("fp", "v1", "v2", "v3")], axis=1)
        col["own"], col["at"] = np.unique(col["node"], return_inverse=True)
        return col, [np.frombuffer(b, "<u8") for b in group.column("shingles").to_pylist()]

    def edges(col: dict, forest: Forest) -> pa.Table:
        moved = np.flatnonzero(forest.root != np.arange(len(forest.root)))
        return pa.table({"a": col["own"][moved], "b": col["own"][forest.root[moved]]})

    def in_block(key, group):  # no annotations: Spark would read them
        col, sets = columns(group)
        every = np.arange(len(sets))
        return edges(col, compared(col, sets, every, every, True, similarity, wide))

    def across(key, group):  # no annotations: Spark would read them
        col, sets = columns(group)
        homes = group.column("as_home").to_numpy()
        return edges(col, compared(col, sets, np.flatnonzero(homes), np.flatnonzero(~homes), False, similarity, wide))

    placed = rows.withColumn("block", F.explode(F.when(F.col("pivot") == 1, F.expr("sequence(0L, blocks - 1)")).otherwise(F.array("own")))).withColumn("part", F.col("node"))
    first = written(placed.groupBy("pack", "block").applyInArrow(in_block, "a long, b long"), "links")
    spread = rows.where("blocks > 1")
    if spread.isEmpty():
        return first
    parts = components_marked(first, spread.select("node", F.col("root").alias("whole"), "pack"), "node").select("node", "whole", F.col("root").alias("part"))
    largest = parts.groupBy("whole", "part").agg(F.count("*").alias("k")).groupBy("whole").agg(F.max_by("part", "k").alias("most"))
    loose = checkpointed(parts.join(largest, "whole").select("node", "part", (F.col("part") != F.col("most")).alias("home")))
    again = spread.join(loose, "node").select(F.col("node").alias("id"), "node", "root", "part", "home", "pack", "fp", "v1", "v2", "v3", "n", "shingles")
    keys = ["pack"]
    dealt = grid(again, keys, CHECK_ROWS, bucket_sizes(again, keys)).drop("home", "id")
    return first.unionByName(dealt.groupBy(*keys, "hb", "mb").applyInArrow(across, "a long, b long"))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits. Null and
    empty texts have fingerprint zero and link like any other; texts of any length are taken whole; repeated rows stay,
    each with its component; rows of one id with other texts have a component each; null ids get their component's
    smallest id, null if it has none; an empty table gives no rows. Copies collapse to one fingerprint before any
    comparison.
    """
    marked = checkpointed(with_fingerprint(docs, words, seed))
    fps = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("node"), "fp", "least"))
    rooted = components_marked(links(fps, radius), fps, "node")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash_components(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_hash():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, times, first_id, first_hash): the distinct rows of ``docs`` (doc_id, text), how often each
    occurs, and the row that stands for its group of near-duplicates.

    Two documents link if the exact Jaccard similarity of their shingles' 64-bit hashes is at least ``similarity``.
    Candidates come from ``near_links``, which misses a share MISS of the pairs at the bound and next to none well
    above it, and lie within the distance of 256 bits that ``similarity`` is expected to give plus SPREAD standard
    deviations. Documents whose 256 bits and shingle counts are equal count as copies. A group is what links connect; the
    row of the smallest doc_id stands for it, of equal ids that of the smallest hash; one without an id only where no
    other has one. Texts without words form one group, null ones among them.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    wide = int(256 * share + SPREAD * (256 * share * (1 - share)) ** 0.5)
    marked = with_wide_fingerprint(docs.select("doc_id", "text", text_hash().alias("text_hash")), words, seed, "doc_id long, text_hash string")
    key = ["fp", "v1", "v2", "v3", "n"]
    marked = written(marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in key)), "marked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least")
    nodes = written(marked.groupBy(*key).agg(least).select(F.monotonically_increasing_id().alias("node"), *key, "least.doc_id", "least.text_hash"), "nodes")
    candidates = checkpointed(near_links(nodes, similarity, wide, share))
    rooted = components_marked(verified_links(docs, nodes, candidates, words, seed, similarity, wide), nodes, "node")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"))
    named = checkpointed(rooted.join(first, "root").select(*key, F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")))
    return marked.join(named, key).select("doc_id", "text_hash", "times", "first_id", "first_hash")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group of ``near_duplicate_groups``.

    Rows that repeat an id with another text are documents of their own; of rows that repeat both, one stays. Other
    columns pass through, whatever their names. Null and empty texts are one group, texts of any length are taken whole, an
    empty table gives no rows. Only rows that a bitmap of those to drop names are shuffled with their texts.
    """
    groups = checkpointed(near_duplicate_groups(docs, words, similarity, seed))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    told = lambda rows: rows.select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"))
    touched = told(groups.where(~first | (F.col("times") > 1)))
    own = possible(docs.withColumn("__near_text", text_hash()), [F.col("doc_id").cast("long"), F.col("__near_text")], touched, [F.col("__near_id"), F.col("__near_hash")], "__near_may")
    same = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_text") == F.col("__near_hash"))
    alone, own = own.where("NOT __near_may"), own.where("__near_may")
    kept = alone.unionByName(own.join(touched, same, "left_anti"))
    repeated = own.join(told(groups.where(first & (F.col("times") > 1))), same, "left_semi").dropDuplicates(["doc_id", "__near_text"])
    return kept.unionByName(repeated).select(docs.columns)
