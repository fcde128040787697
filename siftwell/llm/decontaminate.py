"""Benchmark decontamination (operator 6): spaced-seed hashing, then verified substitution-tolerant overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import BATCH_ROWS, spread, table, written

#: Fixed masks of five selected words; the positions at 0 are ignored and so may differ.
MASKS = ("11111", "111011", "110111", "1101011", "1110011")
#: Words of an item from which the masks find it; shorter ones are found by SHORT, from FEWEST words on.
LONG, SHORT, FEWEST = 7, "11", 3
#: Words of a test set that is sent out whole as an index; the seeds of a larger one are joined.
INDEX_WORDS = 200_000
#: Bits of the filter that a larger test set's seeds pass first: 16 for each seed, within these powers of two.
FILTER_BITS = (22, 29)
#: An overlap counts if it has so many words, or covers so large a share of its item, at this share of equal words.
MIN_WORDS, SIMILARITY = 13, 0.8
#: Spellings whose word hash a worker keeps at most, and hits that are laid out at once.
CACHE, HITS_AT_ONCE = 400_000, 1 << 20
EDGES = re.compile(r"^\W+|\W+$")
HITS = "item_id long, first_word long, last_word long, equal_words long"


def word(spelling: str) -> str:
    return EDGES.sub("", spelling.lower())


class Hashes(dict):
    """Spelling → 64-bit hash of its word: lower case, without punctuation around it. 0 for bare punctuation."""

    def __missing__(self, spelling: str) -> int:
        w = word(spelling)
        n = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 6) | 1 if w else 0
        if len(self) < CACHE:
            self[spelling] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a whole text's words between white space; bare punctuation is none."""
        own = (text or "").split()
        ids = np.fromiter(map(self.__getitem__, own), np.uint64, len(own))
        return ids[ids != 0]


FACTORS = np.random.default_rng(6).integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(ids: np.ndarray, masks: tuple[str, ...]) -> Iterator[np.ndarray]:
    """For each mask the hashes of all windows: a sum of the selected words' hashes by random odd factors."""
    terms = [ids * f for f in FACTORS]
    for mask in masks:
        n = max(0, len(ids) - len(mask) + 1)
        picked = [k for k, bit in enumerate(mask) if bit == "1"]
        h = terms[0][picked[0] : n + picked[0]].copy()
        for t, k in zip(terms[1:], picked[1:]):
            h += t[k : n + k]
        yield h


def text_seeds(ids: np.ndarray, short: bool) -> Iterator[np.ndarray]:
    """Seeds of a document: by every mask, and by SHORT where the test set has short items."""
    return seeds(ids, (*MASKS, SHORT) if short else MASKS)


def item_seeds(ids: np.ndarray) -> list[np.ndarray]:
    """An item's seeds in the order of ``text_seeds``: those of the masks, or of SHORT if it has under LONG words."""
    none = np.zeros(0, np.uint64)
    if len(ids) >= LONG:
        return [*seeds(ids, MASKS), none]
    return [none] * len(MASKS) + (list(seeds(ids, (SHORT,))) if len(ids) >= FEWEST else [none])


def whole_seed(ids: np.ndarray) -> list[np.ndarray]:
    """The hash of a whole text of under FEWEST words, which only meets an equal one."""
    return [np.array([xxhash.xxh64_intdigest(ids.tobytes(), 7)], np.uint64)] if 0 < len(ids) < FEWEST else []


@dataclass(frozen=True)
class Index:
    """Items' words end to end, and their spaced seeds: sorted hashes by mask, with places in the words."""

    words: np.ndarray
    start: np.ndarray
    item_ids: list
    whole: dict[bytes, list[int]]
    short: bool
    hashes: list[np.ndarray]
    positions: list[np.ndarray]
    bitmap: np.ndarray


def build_index(items: list[tuple]) -> Index:
    own = Hashes()
    texts = [own.of(t) for _, t in items]
    start = np.cumsum([0, *map(len, texts)])
    hashes, positions, bitmap, by_item = [], [], np.zeros(1 << 22, bool), [item_seeds(t) for t in texts]
    for m in range(len(MASKS) + 1):
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x[m])) + a for x, a in zip(by_item, start))])
        h = np.concatenate([np.zeros(0, np.uint64), *(x[m] for x in by_item)])
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        positions.append(at[order])
        bitmap[h >> np.uint64(42)] = True
    whole: dict[bytes, list[int]] = {}
    for k, t in enumerate(texts):
        if 0 < len(t) < FEWEST:
            whole.setdefault(t.tobytes(), []).append(k)
    words = np.concatenate([np.zeros(0, np.uint64), *texts])
    return Index(words, start, [i for i, _ in items], whole, any(FEWEST <= len(t) < LONG for t in texts), hashes, positions, bitmap)


def longest_run(equal: np.ndarray) -> tuple[int, int] | None:
    """(first, end) of the longest run of at least MIN_WORDS words of which a share SIMILARITY is equal, or None.

    With prefix sums of equal - SIMILARITY a run counts if its end's sum is no smaller than its start's. Of the
    starts only those with a sum under all before can begin the longest run to an end.
    """
    total = np.concatenate([[0.0], np.cumsum(equal - SIMILARITY)]) + 1e-9 * np.arange(len(equal) + 1)  # for rounding
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")  # the first start whose sum is no larger
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    return (int(first[end]), end) if length[end] >= MIN_WORDS else None


def verified(equal: np.ndarray, length: int) -> tuple[int, int, int] | None:
    """(first, end, equal words) of an ungapped overlap with an item of ``length`` words, or None.

    The whole overlap counts if its equal words are a share SIMILARITY of the item, else its longest run. Words that
    differ at either end are left out of what is returned.
    """
    first, end = 0, len(equal)
    if equal.sum() < SIMILARITY * length - 1e-9:
        run = longest_run(equal)
        if run is None:
            return None
        first, end = run
    at = first + np.flatnonzero(equal[first:end])
    return int(at[0]), int(at[-1]) + 1, len(at)


def least_equal(length: int) -> int:
    """Equal words that any overlap with an item of ``length`` words that counts has at least."""
    return int(np.ceil(min(SIMILARITY * MIN_WORDS, SIMILARITY * length) - 1e-9))


def best_overlap(ids: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(first word, last word, equal words) of the verified overlap with most equal words; of equal ones the first by shift."""
    best, least = None, least_equal(len(item))
    for shift in np.sort(shifts).tolist():
        x, y = max(0, -shift), min(len(item), len(ids) - shift)
        equal = item[x:y] == ids[x + shift : y + shift]
        n = int(equal.sum())
        if n >= least and (best is None or n > best[2]):
            found = verified(equal, len(item))
            if found and (best is None or found[2] > best[2]):
                best = (x + shift + found[0], x + shift + found[1] - 1, found[2])
    return best


def hit_shifts(index: Index, ids: np.ndarray) -> dict[int, np.ndarray]:
    """Item number → distinct shifts at which a seed of the text is one of the item's; hits are laid out in bounded parts."""
    found = np.zeros(0, np.int64)  # an item's number above 40 bits of the shift, which is at most a text's or an item's length
    for h, hashes, positions in zip(text_seeds(ids, index.short), index.hashes, index.positions):
        at = np.flatnonzero(index.bitmap[h >> np.uint64(42)])
        low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        hit = np.flatnonzero(high > low)
        at, low, many = at[hit], low[hit], (high - low)[hit]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + HITS_AT_ONCE, HITS_AT_ONCE))
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            if a < b:
                m = many[a:b]
                there = positions[np.repeat(low[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                item = np.searchsorted(index.start, there, "right") - 1
                code = (item << 40) + (np.repeat(at[a:b], m) - (there - index.start[item]) + (1 << 39))
                found = np.union1d(found, code)
    item, shift = found >> 40, (found & ((1 << 40) - 1)) - (1 << 39)
    cut = np.flatnonzero(item[1:] != item[:-1]) + 1
    return {int(item[a]): shift[a:b] for a, b in zip([0, *cut], [*cut, len(found)])} if len(found) else {}


def overlaps(index: Index, own: Hashes, text: str | None, any_: bool = False) -> dict[int, tuple[int, int, int]]:
    """Item number → (first word, last word, equal words) of its best verified overlap with the text; one only if ``any_``."""
    ids = own.of(text)
    best = {k: (0, len(ids) - 1, len(ids)) for k in index.whole.get(ids.tobytes(), [])} if len(ids) < FEWEST else {}
    for item, shifts in hit_shifts(index, ids).items():
        if any_ and best:
            break
        found = best_overlap(ids, index.words[index.start[item] : index.start[item + 1]], shifts)
        if found:
            best[item] = found
    return best


def distinct_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()


def small(items: DataFrame) -> bool:
    """Whether the items together have at most INDEX_WORDS words, counted by Spark; then they may be sent out whole."""
    words = F.size(F.split(F.trim("text"), r"(?U)\s+")).cast("long")
    return (items.agg(F.sum(words)).first()[0] or 0) <= INDEX_WORDS


def index_of(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in items.orderBy("item_id", "text").collect()]))


def seed_filter(seeded: DataFrame) -> np.ndarray:
    """A bitmap over the upper bits of all item seeds: built from one item's seeds after another, its size bounded."""
    total = seeded.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, 16 * total))), *FILTER_BITS))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in seeded.select("hashes").toLocalIterator():
        at = np.frombuffer(r[0], "<u8") >> np.uint64(64 - bits)
        np.bitwise_or.at(found, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return found


def known():
    """A name that documents of one id and text share."""
    return F.sha2(F.to_json(F.struct("doc_id", "text")), 256)


def joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(name, doc_id, HITS) of the distinct documents that overlap with items of a test set too large to send out.

    Items and documents give their seeds; those of documents pass a bitmap of the items' first. Equal seeds meet in a
    join, from which the distinct shifts of each document and item come; their words are compared in the end.
    """
    spark = docs.sparkSession
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def seeds_of(ids: np.ndarray) -> list[np.ndarray]:
        return [*item_seeds(ids), *whole_seed(ids)]

    def of_items(batches):
        own = Hashes()
        for batch in batches:
            out = [(k, m, h.tobytes()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m, h in enumerate(seeds_of(own.of(t))) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["item", "mask", "hashes"])

    seeded = written(items.select("item", "text").mapInArrow(of_items, "item long, mask int, hashes binary"), "seeds")
    sent = spark.sparkContext.broadcast(seed_filter(seeded))
    unpack = lambda own: F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length(own) / 8 - 1).cast("int")), lambda k: F.substring(own, k * 8 + 1, F.lit(8))))
    there = seeded.select("item", "mask", unpack(F.col("hashes")).alias("at", "h"))

    def of_docs(batches):
        own, bitmap = Hashes(), sent.value
        shift = np.uint64(64 - (len(bitmap).bit_length() + 2))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(8))
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.of(text)
                for m, h in enumerate([*text_seeds(ids, True), *whole_seed(ids)]):
                    bit = h >> shift
                    at = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                    for k in range(0, len(at), HITS_AT_ONCE):
                        part = at[k : k + HITS_AT_ONCE]
                        raw = pa.FixedSizeBinaryArray.from_buffers(kinds[3], len(part), [None, pa.py_buffer(h[part].astype("<u8").tobytes())])
                        columns = [pa.array([name] * len(part), kinds[0]), pa.array(np.full(len(part), m, np.int32)), pa.array(part), raw.cast(pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["name", "mask", "there", "h"])

    named = docs.select(known().alias("name"), "doc_id", "text")
    here = named.select("name", "text").mapInArrow(of_docs, "name string, mask int, there long, h binary")
    # Copies of a document share a name, so their hits are the same.
    met = here.join(there, ["mask", "h"]).select("name", "item", (F.col("there") - F.col("at")).alias("shift")).distinct()
    tried = met.groupBy("name", "item").agg(F.collect_set("shift").alias("shifts"))
    texts = named.dropDuplicates(["name"])
    rows = tried.join(texts, "name").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def compared(batches):
        own = Hashes()
        for batch in batches:
            out = []
            for name, doc, item_id, text, item, shifts in zip(*(batch.column(c).to_pylist() for c in range(6))):
                found = best_overlap(own.of(text), own.of(item), np.array(shifts, np.int64))
                if found:
                    out.append((name, doc, item_id, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), *[pa.int64()] * 5))], ["name", "doc_id", "item_id", "first_word", "last_word", "equal_words"])

    return rows.select("name", "doc_id", "item_id", "text", "item_text", "shifts").mapInArrow(compared, "name string, doc_id long, " + HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, equal_words): a row for each document and item that overlap.

    Words stand between white space, in lower case and without the punctuation around them; documents are taken whole,
    of any length. An overlap starts from an equal spaced seed, is aligned without gaps, and counts if at least 0.8 of the
    item's words are equal or a run of 13 words or more holds 0.8 equal words; of several the one with most equal words is
    told, of equal ones the first. Items of three to six words are found by pairs of words, those of one or two only as a
    document's whole text. Null and empty texts overlap with nothing; repeated rows give repeated results; repeated items
    count once; empty tables give no rows; other columns are ignored, whatever their names. A test set of at most
    INDEX_WORDS words is sent out as an index and documents aren't shuffled; of a larger one seeds are joined.
    """
    items = distinct_items(benchmark)
    if not small(items):
        hits = written(joined_hits(docs, items), "hits").drop("doc_id")
        return docs.select("doc_id", known().alias("name")).join(hits, "name").drop("name")
    sent = index_of(items)

    def found(batches):
        own, index = Hashes(), sent.value
        for batch in batches:
            rows = [(d, index.item_ids[i], *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, hit in sorted(overlaps(index, own, t).items())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "item_id", "first_word", "last_word", "equal_words"])

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, " + HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap with an item (see ``contaminated``); all columns pass through."""
    items = distinct_items(benchmark)
    if not small(items):
        hits = written(joined_hits(docs, items).select(F.col("name").alias("__leak_name")).distinct(), "hits")
        return docs.withColumn("__leak_own", known()).join(hits, F.col("__leak_own") == F.col("__leak_name"), "left_anti").select(docs.columns)
    sent = index_of(items)

    def clean(batches):
        own = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not overlaps(sent.value, own, t, any_=True) for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item: the documents to remove, with the evidence."""
    return contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "first_word", "last_word", "equal_words", F.lit(True).alias("contaminated"))
