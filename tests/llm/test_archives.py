"""ARC files to WARC files and back."""

import gzip
import hashlib
import io

import duckdb
import pandas as pd
import pytest

from tidewell.llm import archives, oracles
from tidewell.llm.common import storage

HTTP = b"HTTP/1.0 200 OK\nX-Page-Id: 4\n\nhello"


def records(data):
    return list(archives.read_arc(io.BufferedReader(archives.Inflated(io.BytesIO(data)), 64)))


def v1():
    block = b"1 0 Crawler\n" + archives.FIELDS[1].encode() + b"\n"
    return b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(block) + block + b"\n"


def v2():
    block = b"2 0 Crawler\n" + archives.FIELDS[2].encode() + b"\n"
    return b"filedesc://b.arc 0.0.0.0 1997 text/plain 200 - - 0 b.arc %d\n" % len(block) + block + b"\n"


def test_both_versions_by_declared_lengths():
    one = v1() + b"http://x.org/a b 1.2.3.4 19970101 text/html %d\n" % len(HTTP) + HTTP + b"\n\ndns:x.org - 19970102030405 text/dns 5\n1\n2\n3\n"
    two = v2() + b"http://y.org/ 1.2.3.4 19980101000000 text/html 200 abc - 99 b.arc %d\n" % len(HTTP) + HTTP + b"\n"
    got = records(one + two)
    assert [(r.number, r.uri, r.date, len(r.block)) for r in got if r.number] == [(1, "http://x.org/a b", "19970101", len(HTTP)), (2, "dns:x.org", "19970102030405", 5), (1, "http://y.org/", "19980101000000", len(HTTP))]
    assert [r.block for r in records(gzip.compress(one[:30]) + gzip.compress(one[30:]) + gzip.compress(two))] == [r.block for r in got]
    kinds = []
    for r in got:
        own, block = next(archives.read_warc(io.BytesIO(archives.converted(r, "f.arc", None))))
        kinds.append((own["warc-type"], own["warc-date"], own["warc-record-id"]))
        assert archives.row(own, block) is None or archives.row(own, block)[4] in (5,)
    assert [k[0] for k in kinds] == ["warcinfo", "response", "resource", "warcinfo", "response"]
    assert [k[1] for k in kinds] == ["1996-09-23T14:21:03Z", "1997-01-01T00:00:00Z", "1997-01-02T03:04:05Z", "1997-01-01T00:00:00Z", "1998-01-01T00:00:00Z"]
    assert archives.record_id("f.arc", 1) == kinds[1][2] != archives.record_id("f.arc", 2)


def test_damage_is_found():
    good = v1() + b"http://x/ 1.2.3.4 19970101000000 text/html 5\nabcde\n"
    assert records(good)[1].block == b"abcde"
    for bad in (good[:-3], good.replace(b"text/html 5", b"text/html five"), good.replace(b"1 0 Crawler", b"3 0 Crawler"), b"nothing\n" + good, good.replace(b"1.2.3.4 ", b"")):
        with pytest.raises(ValueError):
            records(bad)
    with pytest.raises(ValueError):
        records(gzip.compress(good)[:-12])
    data = archives.converted(records(v1() + b"http://x/ 1.2.3.4 19970101000000 text/html %d\n" % len(HTTP) + HTTP)[1], "f", None)
    own, block = next(archives.read_warc(io.BytesIO(data)))
    with pytest.raises(ValueError):
        archives.row(own, block.replace(b"hello", b"hullo"))
    with pytest.raises(ValueError):
        list(archives.read_warc(io.BytesIO(data[:-5])))


def test_a_revisit_keeps_its_headers_and_names_the_response():
    own = records(v1() + b"http://x/ 9.9.9.9 19970101000000 text/html %d\n" % len(HTTP) + HTTP)[1]
    head, block = next(archives.read_warc(io.BytesIO(archives.converted(own, "f", {"id": "<urn:uuid:1>", "uri": "http://y/", "date": "1999-01-01T00:00:00Z"}))))
    assert (head["warc-type"], head["warc-refers-to"], head["warc-refers-to-target-uri"], head["warc-profile"], head["warc-ip-address"]) == ("revisit", "<urn:uuid:1>", "http://y/", archives.PROFILE, "9.9.9.9")
    assert block == b"HTTP/1.0 200 OK\nX-Page-Id: 4\n\n" and archives.row(head, block)[5] == hashlib.sha1(b"hello").hexdigest()


ROWS = [
    (1, "http://a/ b", "x" * 1000), (2, "http://a/é", "x" * 1000), (2, None, "x" * 1000), (None, "http://c/\nd", "x" * 1000), (3, "u", "é" * 500), (9, "u", "é" * 500), (4, "u", "y" * 999), (5, "u", "y" * 999),
    (6, "u", None), (7, "u", ""), (8, "u", "HTTP/1.1 500\r\n\r\n" + "z\n\n" * 400_000), (None, None, "q" * 2000), (None, None, "q" * 2000), (-3, "", "WARC/1.1\r\n" * 300), (12, "u", "\u0000\r\n" * 700),
]


@pytest.mark.parametrize("roll", [1, 3000, archives.ROLL])
def test_pages_come_back(spark, tmp_path, roll):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, record_type string, key int").repartition(3)
    arcs = spark.createDataFrame(archives.write_arc(df, f"file:{tmp_path}/arc", roll=roll).collect(), archives.MANIFEST)
    assert sum(r.records for r in arcs.collect()) == len(ROWS) and (roll > 1 or arcs.count() == len(ROWS))
    heads = {(gzip.open(storage(f"{tmp_path}/arc/{r.file}")[1]).read().split(b"\n")[1])[:1] for r in arcs.collect()}
    assert heads == {b"1", b"2"}
    warcs = spark.createDataFrame(archives.convert(arcs, f"{tmp_path}/arc", f"file://{tmp_path}/warc").collect(), archives.MANIFEST)
    got = archives.resolved(archives.read(warcs, f"{tmp_path}/warc"))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([r[::2] for r in ROWS], columns=["page_id", "html"]).astype({"page_id": "Int64"}))
    expected = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({oracles.ARCHIVES})").fetchall()
    assert sorted(map(tuple, got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(expected, key=repr)
    assert {r.uri for r in got.collect()} >= {"http://a/%20b", "http://a/%C3%A9", "http://c/%0Ad", "urn:page:2"}
    ids = [r.record_id for r in got.collect()]
    assert len(set(ids)) == len(ids)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archived(spark, df).collect() == []


def test_storage():
    for where in ("/a/b", "file:/a/b", "file:///a/b"):
        assert storage(where)[1] == "/a/b"
