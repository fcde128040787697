"""Token ids and binary output (operator 8): sequences in a keyed random training order, in fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import shared_dir, table, union_all, written

#: The tokenizer's vocabulary file, the pattern that goes with it, and the id that ends each document.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Tokens of a sequence and sequences of a shard; ids have two bytes, little-endian.
LENGTH, SHARD = 1024, 512
#: Sequences of a window of training order, and shards that a task writes at least where there are many.
WINDOW, TASK_SHARDS = 8_192, 16
#: Passes that the shards are written in, each over a range of slots, so that only a part of the tokens is shuffled at once.
WAVES = 2
#: Tasks up to which the places of their tokens are broadcast, 16 bytes each.
BROADCAST_ROWS = 1 << 20
#: Documents that are compressed together.
BLOCK_DOCS = 256
ROUNDS, KEY = 6, 8
DTYPE = "<u2"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked along its
    cycle until the result is below n. Needs no table, so every task computes slots by itself."""

    n: int
    key: int = KEY

    @property
    def half(self) -> np.uint64:
        return np.uint64(max(1, (max(1, self.n - 1).bit_length() + 1) // 2))

    def once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        low = (np.uint64(1) << self.half) - np.uint64(1)
        left, right = x >> self.half, x & low
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            key = self.key * ROUNDS + r + 1
            if inverse:
                left, right = right ^ (mixed(left, key) & low), left
            else:
                left, right = right, left ^ (mixed(right, key) & low)
        return (left << self.half) | right

    def __call__(self, x, inverse: bool = False) -> np.ndarray:
        y = self.once(np.asarray(x, np.uint64), inverse)
        while (out := y >= np.uint64(self.n)).any():
            y[out] = self.once(y[out], inverse)
        return y.astype(np.int64)


@dataclass(frozen=True)
class Order:
    """The slot of each of n sequences: permuted within windows of ``window`` sequences, or all together without one.

    A window keeps a sequence near its place in the training order, whatever its length by position.
    """

    n: int
    window: int | None = None
    key: int = KEY

    def __call__(self, sequences: np.ndarray) -> np.ndarray:
        size, slots = self.window or self.n, np.array(sequences, np.int64)
        for w in np.unique(slots // size).tolist():
            own = np.asarray(sequences) // size == w
            slots[own] = w * size + Permutation(min(size, self.n - w * size), self.key + (w << 16))(slots[own] - w * size)
        return slots


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def in_order(docs: DataFrame, files: bool) -> DataFrame:
    """(doc_id, text, file, row) of ``docs``: by the rows' places in their Parquet files, or sorted by doc_id and text.

    Places in files cost no shuffle and are the same however Spark splits the files. Sorted rows have a null place and are
    in order of their partitions.
    """
    if files:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    place = [F.lit(None).cast(kind).alias(c) for c, kind in (("file", "string"), ("row", "long"))]
    return docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("doc_id", "text", *place)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(file, part, at, n, doc_ids, sizes, tokens) as a written table: blocks of documents' ids and end marks, compressed.

    ``docs`` are rows of ``in_order``. Rows that follow one another in a file and in a task are a part, named by its first
    row, or by the task where rows have no place; at is a block's place among a part's tokens. Null and empty texts give
    the end mark alone.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # a vocabulary, whatever the corpus
    kinds = {"file": pa.string(), "part": pa.int64(), "at": pa.int64(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "tokens": pa.binary()}

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        own, pack, task = encoder(ranks.value), zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        part = last = at = None
        for whole in batches:
            rows = whole.column(3).to_numpy(zero_copy_only=False)
            files = whole.column(2).to_pylist()
            k = 0
            while k < whole.num_rows:
                placed = files[k] is not None
                if part is None or placed and (files[k], rows[k]) != last:
                    part, at = (files[k], int(rows[k])) if placed else ("", task), 0
                end = k + 1
                while end < whole.num_rows and end - k < BLOCK_DOCS and (not placed or files[end] == files[k] and rows[end] == rows[end - 1] + 1):
                    end += 1
                batch = whole.slice(k, end - k)
                ids = [np.append(own.encode_to_numpy(text or "", disallowed_special=()), END).astype(DTYPE) for text in batch.column(1).to_pylist()]
                sizes = [len(x) for x in ids]
                row = (*part, at, sum(sizes), batch.column(0).to_pylist(), sizes, pack.compress(np.concatenate(ids).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.values())], list(kinds))
                at += sum(sizes)
                last = (files[k], rows[end - 1] + 1) if placed else None
                k = end

    schema = "file string, part long, at long, n long, doc_ids array<long>, sizes array<long>, tokens binary"
    return written(docs.select("doc_id", "text", "file", "row").mapInArrow(run, schema), "tokens")


def pieces(tokens: DataFrame, length: int, shard: int, order: Order, slots_from: int, slots_to: int) -> DataFrame:
    """(shard, slot, begins, doc_ids, tokens): each block's stretch of every sequence in the range of slots.

    Parts follow one another by the numbers in the names of Spark's files, then by names and rows.
    """
    ends = tokens.groupBy("file", "part").agg(F.max(F.col("at") + F.col("n")).alias("size"))
    number = F.regexp_extract("file", r"/part-([0-9]+)[^/]*$", 1).try_cast("long")
    bases = ends.select("file", "part", (F.sum("size").over(Window.orderBy(number, "file", "part")) - F.col("size")).alias("base"))  # a row for each task

    def run(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(batch.num_rows):
                at, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                sequences = np.arange(at // length, (at + n - 1) // length + 1)
                slots = order(sequences)
                keep = (slots >= slots_from) & (slots < slots_to)
                if not keep.any():
                    continue
                sequences, slots = sequences[keep], slots[keep]
                low, high = np.maximum(sequences * length, at) - at, np.minimum((sequences + 1) * length, at + n) - at
                docs, sizes = batch.column(2)[k].values, batch.column(3)[k].values.to_numpy()
                starts = np.cumsum(sizes) - sizes
                first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high - 1, "right") - 1
                many = last - first + 1
                offsets = np.concatenate([[0], np.cumsum(many)])
                taken = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, many)
                data = memoryview(unpack.decompress(batch.column(4)[k].as_py(), max_output_size=2 * n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(slots // shard), pa.array(slots), pa.array((low + at - sequences * length).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), docs.take(pa.array(taken))),
                    pa.array([pack.compress(data[2 * a : 2 * b]) for a, b in zip(low.tolist(), high.tolist())], pa.binary()),
                ], ["shard", "slot", "begins", "doc_ids", "tokens"])

    # A broadcast keeps the tokens where they are; with more tasks than that both sides are shuffled.
    bases = F.broadcast(bases) if ends.count() <= BROADCAST_ROWS else bases
    placed = tokens.join(bases, ["file", "part"]).select((F.col("base") + F.col("at")).alias("at"), "n", "doc_ids", "sizes", "tokens")
    return placed.mapInArrow(run, "shard long, slot long, begins int, doc_ids array<long>, tokens binary")


def write_shards(docs: DataFrame, path: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY, vocabulary: str = VOCABULARY, window: int | None = None, files: bool = False) -> DataFrame:
    """Writes the shards below ``path`` and returns their sequences: (slot, shard, byte_at, n_tokens, doc_ids, sha1).

    The documents' tokens, each ended by END, run on end to end in the documents' order and are cut into sequences of
    ``length``; the last one is filled up with END. The order is that of the rows in their files with ``files``, for
    tables straight from Parquet files, else by doc_id and text; so runs with other partitions give the same shards.
    Sequence i goes to slot P(i) of a keyed permutation P of all sequences, or of each ``window`` of them in turn, where
    documents stand in training order. Shard k holds the slots from k * shard on, each at a fixed stride of 2 * length
    bytes, so slot s is byte range (s mod shard) * stride of shard s // shard and training reads forward and resumes at
    any slot. Tasks hold ranges of shards. Parts of a shard are written under a name of the attempt and renamed, so a
    task run again leaves the same files. n_tokens counts the tokens before the fill. Null and empty texts are an end
    mark; texts may be of any length; an empty table writes nothing and gives no rows; repeated rows are encoded
    again; other columns are ignored, whatever their names. Slots are written in WAVES passes, each shuffling its
    share only, and the shuffle files of a pass go when it ends.
    """
    spark = docs.sparkSession
    tokens = encoded(in_order(docs, files), vocabulary)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    schema = "slot long, shard long, byte_at long, n_tokens int, doc_ids array<long>, sha1 string"
    if not total:
        return spark.createDataFrame([], schema)
    order = Order(-(-total // length), window, key)
    shards = -(-order.n // shard)

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        unpack, attempt = zstandard.ZstdDecompressor(), TaskContext.get().taskAttemptId()
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        rows: list[tuple] = []
        out = name = at = slot = None
        data, docs_of = bytearray(), []

        def close_sequence():
            n = len(data) // 2
            full = bytes(data) + np.full(length - n, END, DTYPE).tobytes()
            out.write(full)
            rows.append((slot, at, slot % shard * 2 * length, n, list(docs_of), hashlib.sha1(full).hexdigest()))

        def close_shard():
            out.close()
            store.move(f"{name}.{attempt}.tmp", name)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()))], ["slot", "shard", "byte_at", "n_tokens", "doc_ids", "sha1"])

        for got in batches:
            for s, sl, doc, part in zip(*(got.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if sl != slot and slot is not None:
                    close_sequence()
                    data, docs_of = bytearray(), []
                if s != at:
                    if out is not None:
                        close_shard()
                    name, at = f"{base}/shard-{s:08d}.bin", s
                    out = store.open_output_stream(f"{name}.{attempt}.tmp", compression=None)
                slot = sl
                data += unpack.decompress(part, max_output_size=2 * length)
                docs_of += doc
            if len(rows) >= 4096:
                yield batch()
                rows.clear()
        if out is not None:
            close_sequence()
            close_shard()
        if rows:
            yield batch()

    done = []
    for wave in range(WAVES):
        first, last = shards * wave // WAVES, shards * (wave + 1) // WAVES
        if first == last:
            continue
        placed = pieces(tokens, length, shard, order, first * shard, last * shard)
        parts = min(last - first, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(last - first) // TASK_SHARDS)), 1 << 16)
        own = F.floor((F.col("shard") - first) * parts / (last - first)).cast("int")
        dealt = placed.repartitionById(parts, own).sortWithinPartitions("slot", "begins")
        done.append(written(dealt.mapInArrow(write, schema), "sequences"))
    return union_all(done)


def read_slots(path: str, first: int, number: int, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """The ids of ``number`` sequences from slot ``first`` on, by fixed strides: how a trainer starts or resumes."""
    store, base = pafs.FileSystem.from_uri(path)
    out = []
    while number > 0:
        k, at = divmod(first, shard)
        n = min(number, shard - at)
        with store.open_input_file(f"{base}/shard-{k:08d}.bin") as f:
            f.seek(at * 2 * length)
            out.append(np.frombuffer(f.read(n * 2 * length), DTYPE).reshape(-1, length))
        first, number = first + n, number - n
    return np.concatenate(out) if out else np.zeros((0, length), DTYPE)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the shards of all documents: slot, shard, byte_at, n_tokens, doc_ids, sha1."""
    return write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"), files=True)
