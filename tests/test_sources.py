import hashlib
import os
import zipfile

import pytest

from siftwell.sources import readers, sinks


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "line long, value string")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"row {k}\r\n" if k % 3 else "\n" for k in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line, r.value) for r in got] == [(k, f"row {k}" if k % 3 else "") for k in range(1, 5001)]


def test_record_faults_in_order(spark):
    values = ['{"id":"1","text":"a","spam":true}', "", '{"id":" ","text":" ","spam":true}', '{"id":"2","text":"\\u00a0","slop":false}', '{"id":"3","text":"a"}', '{"id":"4","text":"a","spam":true,"more":1}', '{"id":"5","text":"a","spam":"yes"}', "{", '{"id":"1","text":"b","slop":true}', '{"id":"6","text":"a","spam":true,"context":"forum"}', '{"id":"7","text":"a","spam":true,"context":"elsewhere"}']
    got = {r.line: (r.error, r.context) for r in readers.parsed_records(lines(spark, values)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 3: "empty_id", 4: "empty_text", 5: "no_labels", 6: "json", 7: "json", 8: "json", 9: "duplicate_id", 10: None, 11: "json"}
    assert got[1][1] == "other" and got[10][1] == "forum"
    assert tuple(readers.first_error(readers.parsed_records(lines(spark, values))).first()) == (3, "empty_id")
    assert readers.first_error(readers.parsed_records(lines(spark, values[:2]))).count() == 0


def test_tsv(spark):
    got = readers.labelled_tsv(lines(spark, ["ham\ta\tb", "", "spam\tc", "other\td", "none"]), "s").orderBy("id").collect()
    assert [(r.id, r.text, r.spam, r.error) for r in got] == [("s:1", "a\tb", False, None), ("s:3", "c", True, None), ("s:4", "d", None, "bad_line"), ("s:5", None, None, "bad_line")]


def test_csv(spark, tmp_path):
    (tmp_path / "Youtube01.csv").write_text('COMMENT_ID,AUTHOR,DATE,CONTENT,CLASS\nx,a,d,"two\nlines, ""quoted""",1\ny,a,d,plain,0\nx,b,d,"two\nlines, ""quoted""",1\n', encoding="utf-8-sig")
    found, conflicts = readers.deduplicated(readers.comment_csv(spark, str(tmp_path), "yt"))
    assert {(r.id, r.text, r.spam) for r in found.collect()} == {("yt:Youtube01:x", 'two\nlines, "quoted"', True), ("yt:Youtube01:y", "plain", False)}
    assert conflicts.count() == 0


def test_domains(spark):
    good, bad = readers.domain_list(lines(spark, ["Example.COM", "# comment", "bücher.example", "example.com", "", "single", "-a.example", "x" * 64 + ".example"]))
    assert [r[0] for r in good.collect()] == ["example.com", "xn--bcher-kva.example"]
    assert sorted(r.line for r in bad.collect()) == [6, 7, 8]


def test_ip_ranges_skip_malformed_lines(spark):
    got = readers.ip_ranges(lines(spark, ["203.0.113 0.9", "# 1.2.3 0.4", "1.2.3.4 0.5", "1.2 0.5", "1.2.300 0.5", "1.2.3 x", "1.2.3", ""])).collect()
    assert [tuple(r) for r in got] == [("203.0.113", 0.9)]


def test_checksum_and_gate(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"data")
    assert readers.verified(spark, str(tmp_path / "p"), hashlib.sha256(b"data").hexdigest().upper()).first().matches
    assert not readers.verified(spark, str(tmp_path / "p"), "0" * 64).first().matches
    assert [readers.gate(spark.range(5), a, b).first().ok for a, b in ((5, 5), (6, 9), (0, 4))] == [True, False, False]
    with pytest.raises(ValueError):
        readers.gate(spark.range(5), 3, 2)


def test_sources_are_selected(spark):
    m = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "pos long, id string")
    assert [r.id for r in readers.selected_sources(m, []).collect()] == ["b", "a", "c"]
    assert [r.id for r in readers.selected_sources(m, ["c", "a", "c"]).collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="x"):
        readers.selected_sources(m, ["x", "a"])


def test_manifest_guards():
    good = {"id": "a", "output": "data/a.txt", "license_url": "https://x", "minimum_records": 1, "maximum_records": 2}
    readers.check_manifest([good])
    for bad in ({"output": "../a"}, {"output": "/a"}, {"license_url": "http://x"}, {"minimum_records": 3}):
        with pytest.raises(ValueError):
            readers.check_manifest([good | bad])
    with pytest.raises(ValueError):
        readers.check_manifest([good, good | {"id": "b"}])


def test_sink_replaces_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_json(spark.range(3), path)
    sinks.write_json(spark.range(5), path)
    assert spark.read.json(path).count() == 5 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(ValueError):
        sinks.refresh({path: spark.range(7), str(tmp_path / "b"): spark.range(0)})
    assert spark.read.json(path).count() == 5 and os.listdir(tmp_path) == ["out"]


def test_requests(spark):
    values = ['{"text":"a","author_ip":"::1","more":1}', '{"text":"a","author_ip":"nope"}', '{"context":"forum"}', '{"text":"a","context":"forum"}']
    got = [(r.context, r.ok) for r in readers.decoded_requests(lines(spark, values)).orderBy("line").collect()]
    assert got == [("other", True), ("other", False), ("forum", False), ("forum", True)]


def test_refresh_is_whole_and_noted(spark, tmp_path):
    a, b, note = (str(tmp_path / x) for x in ("a", "b", "provenance"))
    assert sinks.refresh({a: spark.range(3), b: spark.range(4)}, provenance=note, notes={a: {"url": "https://x"}}) == {a: 3, b: 4}
    assert {(r.path, r.records, r.notes) for r in spark.read.json(note).collect()} == {(a, 3, '{"url": "https://x"}'), (b, 4, "{}")}
    fails = spark.range(9).selectExpr("raise_error('source lost') AS x")
    with pytest.raises(Exception, match="source lost"):
        sinks.refresh({a: spark.range(8), b: fails})
    assert spark.read.json(a).count() == 3 and spark.read.json(b).count() == 4 and sorted(os.listdir(tmp_path)) == ["a", "b", "provenance"]


def test_a_failed_rename_restores_the_old_result(spark, tmp_path):
    a, b = (str(tmp_path / x) for x in ("a", "b"))
    sinks.write_json(spark.range(3), a)
    sinks.write_json(spark.range(4), b)
    with pytest.raises(Exception):
        sinks.swap(spark, {a: sinks.written_beside(spark.range(9), a), b: str(tmp_path / "absent")})
    assert spark.read.json(a).count() == 3 and spark.read.json(b).count() == 4


def test_members_of_zip_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "sms.zip", "w") as z:
        z.writestr("SMSSpamCollection", "ham\thello\r\n\nspam\twin\tnow\nodd line\n")
        z.writestr("readme", "ham\tnot this\n")
    got = readers.labelled_tsv_zip(spark, str(tmp_path / "sms.zip"), "sms").orderBy("id").collect()
    assert [(r.id, r.text, r.spam, r.error) for r in got] == [("sms:1", "hello", False, None), ("sms:3", "win\tnow", True, None), ("sms:4", None, None, "bad_line")]
    with zipfile.ZipFile(tmp_path / "yt.zip", "w") as z:
        z.writestr("x/Youtube02.csv", "\ufeffCOMMENT_ID,CONTENT,CLASS\nb,plain,0\n")
        z.writestr("x/Youtube01.csv", '\ufeffCOMMENT_ID,AUTHOR,CONTENT,CLASS\na,me,"two\nlines, ""quoted""",1\n')
        z.writestr("x/notes.csv", "COMMENT_ID\nq\n")
    got = {(r.id, r.text, r.spam) for r in readers.comment_zip(spark, str(tmp_path / "yt.zip"), "yt").collect()}
    assert got == {("yt:Youtube01:a", 'two\nlines, "quoted"', True), ("yt:Youtube02:b", "plain", False)}
