import ipaddress
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.functions import fingerprint as fp

#: Fixed values of the unkeyed hash.
VECTORS = {"": 0x0000000000000000, "hello": 0xB86414A71183D9A7}


@pytest.mark.parametrize("text", VECTORS)
def test_simhash_of_known_texts(text):
    assert fp.simhash(text, "sip") & fp.FULL == VECTORS[text]


@pytest.mark.parametrize("text", ["Seven green bottles", "the ferry leaves the north pier at noon", "a a a b", "Größe und Maß", "x" * 200, " tabs\tand\u3000wide blanks\n"])
def test_simhash_by_its_definition(text):
    words = text.lower().split()
    hashes = [fp.siphash13(p.encode() + b"\xff") for p in words + [" ".join(p) for p in zip(words, words[1:])]]
    assert fp.simhash(text, "sip") & fp.FULL == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_buckets(spark):
    rows = [("203.0.113.5",), ("203.0.113.200",), ("198.51.100.5",), ("2001:db8:1:aaaa::1",), ("2001:db8:1:bbbb::2",), ("nope",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "ip string").select(fp.ip_bucket("ip")).collect()]
    want = [0xA3F018F4E876A154, 0xA3F018F4E876A154, 0x403E130D68C517E9, 0x57F6AB698B99457C, 0x57F6AB698B99457C]
    assert [x & fp.FULL for x in got[:5]] == want and got[5:] == [None, None]
    keys = [r[0] for r in spark.createDataFrame([*rows, ("1.2.3",), ("01.2.3.4",), ("1.2.3.256",)], "ip string").select(fp.ipv4_key(F.col("ip"))).collect()]
    assert keys[:3] == ["203.0.113", "203.0.113", "198.51.100"] and keys[3:] == [None] * 7


def test_network_fingerprints():
    assert fp.network_fingerprint(0x1122334455667788, b"test-network-secret-with-at-least-32-bytes") == 0xA9CBAE0495495A65
    assert fp.network_fingerprint(0x1122334455667788, b"another-network-secret-with-32-bytes-minimum") == 0xE794233280A4B170


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    own = [rng.getrandbits(64) for _ in range(60)]
    own += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * (k % 2) for k, x in enumerate(own)]
    own = [fp.signed(x) for x in set(own)]
    df = spark.createDataFrame([(x,) for x in own], "l long")
    got = {(r.l, r.r, r.distance) for r in fp.near_pairs(df, df.withColumnRenamed("l", "r")).collect()}
    want = {(a, b, ((a ^ b) & fp.FULL).bit_count()) for a in own for b in own if ((a ^ b) & fp.FULL).bit_count() <= 3}
    assert got == want and len(want) > len(own)


def test_many_hashes_equal_single_ones():
    rng = random.Random(3)
    data = [rng.randbytes(n) for n in (0, 1, 7, 8, 9, 15, 16, 23, 24, 100) for _ in range(5)]
    assert fp.siphash13_many(data, 5, 6).tolist() == [fp.siphash13(d, 5, 6) for d in data]
    assert fp.siphash13_many([]).tolist() == []


def test_keyed_column_equals_single_values(spark):
    values = [0, 1, -1, 0x1122334455667788, None, -(1 << 63)]
    secret = "test-network-secret-with-at-least-32-bytes"
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, fp long").select("k", fp.network_fp_sip(F.col("fp"), secret).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [None if v is None else fp.signed(fp.network_fingerprint(v, secret.encode())) for v in values]


def test_network_keys_equal_plain_parsing(spark):
    cases = ["::", "::1", "1::", "2001:db8:1::5", "2001:DB8:0001:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1.2.3.4", "0:00:000:1::"]
    cases += [":1::2", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "12345::", "g::", "1:2:3:4:5:6:7:8::", "::1%eth0", "1.2.3", "1.2.3.256", "01.2.3.4", "::1.2.3.256", "::1.2.3.4:5", "", " ::1", ":::", "1:::2", None]

    def plain(ip):
        try:
            own = ipaddress.ip_address(ip or "")
        except ValueError:
            return None
        if getattr(own, "scope_id", None):
            return None
        return ".".join(str(own).split(".")[:3]) if own.version == 4 else ":".join(f"{int(g, 16):x}" for g in own.exploded.split(":")[:3])

    got = spark.createDataFrame([(k, ip) for k, ip in enumerate(cases)], "k int, ip string").select("k", fp.ip_key(F.col("ip")).alias("key")).orderBy("k").collect()
    assert [(ip, r.key) for ip, r in zip(cases, got)] == [(ip, plain(ip)) for ip in cases]


@pytest.mark.parametrize("parts", [4, 6, 8])
def test_near_pairs_by_any_number_of_parts(spark, parts):
    rng = random.Random(parts)
    base = [rng.getrandbits(60) for _ in range(40)]
    own = list({x ^ sum({1 << rng.randrange(60) for _ in range(k % 5)}) for k in range(5) for x in base})
    df = spark.createDataFrame([(x,) for x in own], "l long")
    got = sorted((r.l, r.r) for r in fp.near_pairs(df, df.withColumnRenamed("l", "r"), bits=60, parts=parts).collect())
    assert got == sorted((a, b) for a in own for b in own if (a ^ b).bit_count() <= 3)


def test_only_few_keys_are_broadcast(spark, monkeypatch):
    own = [fp.signed(random.Random(k).getrandbits(64) ^ bit) for k in range(200) for bit in (0, 5)]
    df = spark.createDataFrame([(x,) for x in own], "l long")
    pairs = lambda: fp.near_pairs(df, df.withColumnRenamed("l", "r"))
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    few = pairs()
    monkeypatch.setattr(fp, "BROADCAST", 4 * len(own) - 1)
    many = pairs()
    assert "Broadcast" in plan(few) and "Broadcast" not in plan(many) and "SortMergeJoin" in plan(many)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() >= 2 * len(own)


def test_keys_of_a_small_table_are_merged_not_broadcast_when_many(spark, tmp_path):
    # By its file's size, under a megabyte, the planner takes the table for one to broadcast; its keys are twenty times as many.
    spark.range(0, 40000, 1, 1).selectExpr("xxhash64(id) AS l").write.parquet(str(tmp_path / "own"))
    df = spark.read.parquet(str(tmp_path / "own"))
    assert "Broadcast" not in fp.near_pairs(df, df.withColumnRenamed("l", "r"), parts=6)._jdf.queryExecution().sparkPlan().toString()


def test_texts_of_a_batch_and_in_pieces_equal_single_ones(monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " \x1c ", "a\x1cb c", "\u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3. \u0130x", *(" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randrange(700))) for _ in range(40))]

    def plain(text, kind):
        words = [w.lower() for w in fp.BLANK.split(text or "") if w]
        parts = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        h = [int(x) for x in fp.part_hashes(parts, kind)] if parts else []
        return fp.signed(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))

    for kind in ("md5", "sip"):
        want = [plain(t, kind) for t in texts]
        for words, piece in ((1 << 15, 1 << 17), (50, 1 << 17), (50, 64), (1, 1)):
            monkeypatch.setattr(fp, "WORDS", words)
            monkeypatch.setattr(fp, "PIECE", piece)
            assert fp.simhashes(texts, kind).tolist() == want
    assert fp.simhashes([], "sip").tolist() == []


def test_each_different_part_of_a_batch_is_hashed_once(monkeypatch):
    asked, whole = [], fp.part_hashes
    monkeypatch.setattr(fp, "part_hashes", lambda parts, kind: asked.extend(parts) or whole(parts, kind))
    fp.simhashes(["a b a b", "B A", "a"] * 50, "sip")
    assert sorted(asked) == ["a", "a b", "b", "b a"]


def test_few_texts_of_a_batch_are_strings_at_a_time():
    seen = []
    fp.in_slices(pa.array(["text"] * 10_000), lambda some: seen.append(len(some)) or fp.simhashes(some, "md5"))
    assert sum(seen) == 10_000 and max(seen) <= 256
