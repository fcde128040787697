"""Hashes and fingerprints. Sixty-four unsigned bits are stored in a signed long."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siftwell.functions.text import in_slices

try:
    from _md5 import md5  # the plain one starts faster on short strings
except ImportError:
    from hashlib import md5

#: The keys of the unkeyed 64-bit hash.
KEY0, KEY1 = 0x9E3779B97F4A7C15, 0xF39CBB7EEEA7C457
#: Rows of keys that a near-join broadcasts at most, about 15 MB.
BROADCAST = 1 << 17
FULL = (1 << 64) - 1
#: Unicode white space; Python's own class holds four separators more.
BLANK = re.compile(r"[^\S\x1c-\x1f]+")
#: Words that are hashed together, and characters of a text that are split together.
WORDS, PIECE = 1 << 15, 1 << 17
#: A byte's bits as the eight bytes of a word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def siphash13(data: bytes, k0: int = KEY0, k1: int = KEY1) -> int:
    """SipHash with one compression and three finalisation rounds (Aumasson and Bernstein, 2012)."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def turn(x: int, by: int) -> int:
        return (x << by | x >> (64 - by)) & FULL

    def rounds(n: int) -> None:
        a, b, c, d = v
        for _ in range(n):
            a = (a + b) & FULL
            b = turn(b, 13) ^ a
            a = turn(a, 32)
            c = (c + d) & FULL
            d = turn(d, 16) ^ c
            a = (a + d) & FULL
            d = turn(d, 21) ^ a
            c = (c + b) & FULL
            b = turn(b, 17) ^ c
            c = turn(c, 32)
        v[:] = a, b, c, d

    whole = len(data) // 8
    tail = data[whole * 8 :].ljust(7, b"\0") + bytes([len(data) & 255])
    for (m,) in struct.iter_unpack("<Q", data[: whole * 8] + tail):
        v[3] ^= m
        rounds(1)
        v[0] ^= m
    v[2] ^= 255
    rounds(3)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def siphash13_many(data: list[bytes], k0: int = KEY0, k1: int = KEY1) -> np.ndarray:
    """``siphash13`` of many byte strings at once, as unsigned words: all of one number of blocks together."""
    out, blocks = np.zeros(len(data), np.uint64), np.array([len(d) // 8 + 1 for d in data], np.int64)
    turn = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)

    def rounds(v: list[np.ndarray], n: int) -> None:
        for _ in range(n):
            v[0] = v[0] + v[1]
            v[1] = turn(v[1], 13) ^ v[0]
            v[0] = turn(v[0], 32)
            v[2] = v[2] + v[3]
            v[3] = turn(v[3], 16) ^ v[2]
            v[0] = v[0] + v[3]
            v[3] = turn(v[3], 21) ^ v[0]
            v[2] = v[2] + v[1]
            v[1] = turn(v[1], 17) ^ v[2]
            v[2] = turn(v[2], 32)

    for n in np.unique(blocks).tolist():
        at = np.flatnonzero(blocks == n)
        padded = b"".join(data[k].ljust(8 * n - 1, b"\0") + bytes([len(data[k]) & 255]) for k in at)
        m = np.frombuffer(padded, "<u8").reshape(-1, n)
        v = [np.full(len(at), x, np.uint64) for x in (k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573)]
        for k in range(n):
            v[3] = v[3] ^ m[:, k]
            rounds(v, 1)
            v[0] = v[0] ^ m[:, k]
        v[2] = v[2] ^ np.uint64(255)
        rounds(v, 3)
        out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str) -> list[str]:
    """Lower-case runs between Unicode white space; ``str.split`` parts at four separators more."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in BLANK.split(text.lower()) if w]
    return text.lower().split()


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters that end between words."""
    at = 0
    while len(text) - at > PIECE and (cut := BLANK.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def part_hashes(parts: list[str], kind: str) -> np.ndarray:
    if kind == "sip":
        return siphash13_many([p.encode() + b"\xff" for p in parts])  # strings are ended by the byte FF
    return np.frombuffer(b"".join([md5(p.encode()).digest()[:8] for p in parts]), ">u8").astype("<u8") >> np.uint64(4)


def tally(count: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Adds the bits of each hash to its owner's row of ``count``; ``owner`` ascends."""
    if not len(h):
        return
    new = np.diff(owner, prepend=-1) != 0
    first = np.flatnonzero(new)
    # Eight counters of a byte in one word hold up to 255 hashes.
    starts = np.flatnonzero((np.arange(len(h)) - first[np.cumsum(new) - 1]) % 255 == 0)
    sums = np.add.reduceat(LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)], starts, axis=0)
    np.add.at(count, owner[starts], sums.astype("<u8").view(np.uint8).reshape(-1, 64))


def simhashes(texts: list[str | None], kind: str) -> np.ndarray:
    """Of each text the bits set in over half of the hashes of its lower-case words and adjacent word pairs; 0 if it has none.

    ``sip`` takes the keyed hash, ``md5`` the first 60 bits of MD5, which SQL engines share. About WORDS words are
    hashed together, each different word and pair once; a long text goes through in pieces.
    """
    count, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    words: list[str] = []
    runs: list[tuple[int, int]] = []  # text, number of words
    carried = 0  # 1 if the first word ended the part of its text that was counted before

    def flush() -> None:
        known = list(dict.fromkeys(words))
        place = {w: k for k, w in enumerate(known)}
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        owner = np.repeat([r[0] for r in runs], [r[1] for r in runs])
        left = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(at[left] * len(known) + at[left + 1], return_inverse=True)
        h = part_hashes(known + [f"{known[a]} {known[b]}" for a, b in zip(*(x.tolist() for x in np.divmod(pairs, len(known))))], kind)
        for own, of in ((h[at[carried:]], owner[carried:]), (h[len(known) + which], owner[left])):
            tally(count, own, of)
            total[:] += np.bincount(of, minlength=len(texts))

    for k, text in enumerate(texts):
        for piece in pieces(text or ""):
            own = words_of(piece)
            words += own
            runs.append((k, len(own)))
            if len(words) >= WORDS:
                flush()
                words, runs, carried = words[-1:], [(k, 1)], 1
    if len(words) > carried:
        flush()
    return np.packbits(2 * count > total[:, None], axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64)


def simhash(text: str | None, kind: str) -> int:
    """``simhashes`` of one text."""
    return int(simhashes([text], kind)[0])


@F.arrow_udf(LongType())
def simhash_md5(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda some: simhashes(some, "md5"))


@F.arrow_udf(LongType())
def simhash_sip(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda some: simhashes(some, "sip"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4_key(ip: Column) -> Column:
    """The first three octets of a strict dotted quad as text, else null."""
    return F.nullif(F.regexp_extract(ip, rf"^({OCTET}\.{OCTET}\.{OCTET})\.{OCTET}$", 1), F.lit(""))


def ipv6_key(ip: Column) -> Column:
    """The first three groups of an IPv6 address as lower-case text without leading zeros, else null.

    "::" stands for one group of zeros or more, once; the last two groups may be a dotted quad, zones aren't allowed.
    """
    plain = F.regexp_replace(ip, rf"(?<=:){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$", "0:0")
    groups = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))
    halves = F.split(plain, "::", -1)
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    n, short = F.size(left) + F.size(right), F.size(halves) == 2
    sound = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & F.when(short, n <= 7).otherwise((F.size(halves) == 1) & (n == 8))
    whole = F.concat(left, F.when(short & (n < 8), F.array_repeat(F.lit("0"), 8 - n)).otherwise(F.array().cast("array<string>")), right)
    return F.when(sound, F.array_join(F.transform(F.slice(whole, 1, 3), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":"))


def ip_key(ip: Column) -> Column:
    """An address's network as text: three octets or three groups, null of anything else."""
    return F.coalesce(ipv4_key(ip), ipv6_key(ip))


@F.pandas_udf(LongType())
def ip_bucket(ips: pd.Series) -> pd.Series:
    """The hash of an address's network, /24 or /48; null of anything else."""
    parts: dict[str, bytes] = {}
    for ip in set(ips.dropna()):
        try:
            own = ipaddress.ip_address(ip)
        except ValueError:
            continue
        if getattr(own, "scope_id", None) is None:
            # Three octets or three little-endian words, after their number.
            parts[ip] = struct.pack("<Q", 3) + (own.packed[:3] if own.version == 4 else b"".join(own.packed[k : k + 2][::-1] for k in (0, 2, 4)))
    hashes = dict(zip(parts, siphash13_many(list(parts.values())).view(np.int64).tolist()))
    return ips.map(hashes.get).astype("Int64")


def network_key(secret: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.sha256(secret).digest()[:16])


def network_fingerprint(fp: int, secret: bytes) -> int:
    return siphash13(struct.pack("<q", fp), *network_key(secret))


def network_fp_sip(fp: Column, secret: str) -> Column:
    """The keyed fingerprint: ``network_fingerprint`` of each value as a signed long. Equal fingerprints meet, near ones don't."""
    keys = network_key(secret.encode())

    @F.pandas_udf(LongType())
    def keyed(fps: pd.Series) -> pd.Series:
        known = fps.dropna().astype("int64")
        return pd.Series(siphash13_many([struct.pack("<q", x) for x in known], *keys).view(np.int64), known.index, dtype="Int64").reindex(fps.index)

    return keyed(fp)


def network_fp_sha(fp: Column, secret: str) -> Column:
    """A keyed fingerprint by native functions: 64 bits of SHA-256 over the secret and the fingerprint."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(secret), fp.cast("string")), 256), 1, 16)


def tenant_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 32)


def near_pairs(left: DataFrame, right: DataFrame, radius: int = 3, bits: int = 64, parts: int | None = None) -> DataFrame:
    """(l, r, distance) of the fingerprints of ``left`` (column l) and ``right`` (column r) within ``radius`` bits.

    Of ``parts`` stretches of bits all but radius are equal in every pair, so an equi-join on each choice of so many
    stretches finds every pair; the distance then decides. With radius + 1 parts a fingerprint has radius + 1 short
    keys; with more parts it has more and longer ones, which few others share by chance, so large tables want them:
    by default, from 2 ** 18 fingerprints on the right, radius + 3. Both sides' fingerprints should be distinct, so copies
    meet once. The right side's keys are broadcast while they are at most BROADCAST rows; the planner, which takes their
    size for that of the fingerprints, would send many times what it allows through the driver. More are sorted and merged.
    """
    known = right.count()
    if parts is None:
        parts = radius + 1 if known < 1 << 18 else radius + 3
    width = -(-bits // parts)
    mask = (1 << width) - 1
    chosen = [sum(mask << k * width for k in pick) & FULL for pick in combinations(range(parts), parts - radius)]
    masks = [F.lit(signed(m)) for m in chosen]
    keys = lambda c: F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.bitwiseAND(m).alias("v")) for k, m in enumerate(masks))))
    a = left.select("l", keys(F.col("l")).alias("key")).select("l", "key.k", "key.v")
    b = right.select("r", keys(F.col("r")).alias("key")).select("r", F.col("key.k").alias("k2"), F.col("key.v").alias("v2"))
    b = F.broadcast(b) if known * len(masks) <= BROADCAST else b.hint("merge")
    met = a.join(b, (F.col("k") == F.col("k2")) & (F.col("v") == F.col("v2")))
    # A pair counts in the first of its equal keys only, which spares a distinct.
    first = F.array_position(F.array(*(F.col("l").bitwiseXOR(F.col("r")).bitwiseAND(m) == 0 for m in masks)), F.lit(True)) == F.col("k") + 1
    return met.where(hamming(F.col("l"), F.col("r")) <= radius).where(first).withColumn("distance", hamming(F.col("l"), F.col("r"))).select("l", "r", "distance")
