import gzip

import duckdb
import pytest

from siftwell.llm import warc
from siftwell.llm.common import shared_dir

PAGES = "page_id long, url string, html string"


def pages(spark):
    big, other = "<p>ä</p>" * 200, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", other), (4, "http://a/4", other), (5, None, None), (6, "http://a/\r\nb", ""), (7, "http://b/", "y" * 1000), (8, "http://b/", "WARC/1.0\r\n\r\n" * 100), (None, "http://c/", big), (2, "http://a/2", big), (9, "u", "z" * 500_000)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    path = shared_dir(spark, "warc-test")
    df = pages(spark).selectExpr("*", "1 AS payload", "2 AS first")
    warc.archive(df, path, compression=compression)
    got = warc.read_archive(spark, path)
    kinds = sorted((str(r.record_id), r.record_type, r.refers_to) for r in got.collect())
    assert [k for k in kinds if k[1] == "revisit"] == [("urn:page:1", "revisit", "urn:page:2"), ("urn:page:none", "revisit", "urn:page:2")]
    assert len(kinds) == 11
    bodies = {bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert bodies == {r.html or "" for r in df.collect()}
    digest = warc.read_archive(spark, path, payload="digest")
    assert all(r.payload is None and len(r.payload_digest) == 40 for r in digest.collect())


def test_filters_are_pushed_and_payloads_skipped(spark):
    path = shared_dir(spark, "warc-test")
    warc.archive(pages(spark), path)
    got = warc.read_archive(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://a/%'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("BatchScan")[0].split("Filter")[-1] and "StartsWith" not in plan
    assert got.count() == 1
    assert warc.read_archive(spark, path, recordTypes="revisit").count() == 2
    assert warc.read_archive(spark, path, payload="skip").where("target_uri = 'u'").first().payload is None


def test_other_writers_members_are_read(spark, tmp_path):
    one = warc.record("response", "urn:x:1", "http://a", b"hello", "0" * 40, None, "2020-01-01T00:00:00Z")
    two = warc.record("metadata", "urn:x:2", None, b"", "0" * 40, None, "2020-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    got = warc.read_archive(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("urn:x:1", b"hello"), ("urn:x:1", b"hello"), ("urn:x:2", b"")]
    assert warc.read_archive(spark, f"file://{tmp_path}", recordTypes="metadata").count() == 1


def test_members_of_several_records_are_read_whole(spark, tmp_path):
    made = [warc.record("response", f"urn:x:{k}", "http://a", b"hello" * (k * 9000 + 1), "0" * 40, None, "2020-01-01T00:00:00Z") for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(made[:3])) + gzip.compress(made[3]) + warc.member(made[4]))
    for options in ({}, {"payload": "skip"}):
        got = warc.read_archive(spark, f"file://{tmp_path}", **options).orderBy("record_id").collect()
        assert [r.record_id for r in got] == [f"urn:x:{k}" for k in range(5)]
        assert options or [len(r.payload) for r in got] == [5 * (k * 9000 + 1) for k in range(5)]


def test_header_flags_and_digests_of_other_writers(spark, tmp_path):
    import zlib

    one = warc.record("revisit", "urn:x:1", "http://a", b"", "OU4AQAOBVAQZ6YKAM5PTCYYZF5BL2ZIC", "urn:x:0", "2020-01-01T00:00:00Z")
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(one) + packed.flush()
    extra = b"ab" + warc.struct.pack("<H", 3) + b"xyz"
    head = b"\x1f\x8b\x08" + bytes([2 | 4 | 8]) + b"\0" * 4 + b"\0\xff" + warc.struct.pack("<H", len(extra)) + extra + b"name\0" + b"\1\2"
    (tmp_path / "b.warc.gz").write_bytes((head + body + warc.struct.pack("<II", zlib.crc32(one), len(one))) * 2)
    got = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert len(got) == 2 and all(r.record_id == "urn:x:1" and r.payload_digest == warc.base64.b32decode("OU4AQAOBVAQZ6YKAM5PTCYYZF5BL2ZIC").hex() for r in got)


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    df = pages(spark)
    want = sorted(map(str, warc.as_records(df).collect()))
    monkeypatch.setattr(warc, "SENT_ROWS", 0)
    assert sorted(map(str, warc.as_records(df).collect())) == want


def test_members_are_standard_gzip():
    assert gzip.decompress(warc.member(b"abc" * 1000)) == b"abc" * 1000


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, warc.op1_warc(spark, d).collect())) == sorted(con.sql(warc.ORACLE).fetchall())


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    warc.archive(spark.createDataFrame([], PAGES), path)
    import os

    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    assert warc.read_archive(spark, path).count() == 0
