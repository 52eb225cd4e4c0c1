import gzip
import hashlib

import pytest

from tessera.llm import warc as W
from tessera.session import shared_path


def test_round_trip(spark, tmp_path):
    big = "é" * 60 + "\r\n\r\nWARC/1.1\r\n<p>"
    rows = [(1, "http://a.org/x y", "tiny"), (2, "http://a.org/2", "tiny"), (3, None, None), (4, "", ""), (9, "http://b.org/", big), (5, "http://b.org/\n5", big),
            (7, "http://b.org/7", big), (None, "http://n.org/", big), (8, "u", "line\n" * 400000), (6, "http://b.org/6", "\n" + big), (6, "http://b.org/6", "\n" + big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    arc, out = shared_path(spark, "tests", "arc"), shared_path(spark, "tests", "warc")
    W.write_arc(pages, arc, file_bytes=500)
    W.write_warc(W.convert(W.read_arc(spark, arc)), out)
    back = W.read_warc(spark, out).collect()
    info = [r for r in back if r.record_type == "warcinfo"]
    got = sorted([(r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back if r.record_type != "warcinfo"], key=str)
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        head = {big: 5}.get(html)
        revisit = head is not None and key is not None and key != head
        want.append((None if key is None else str(key), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(head) if revisit else None))
    assert got == sorted(want, key=str) and len(info) > 2
    for r in back:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert {r.version for r in W.read_arc(spark, arc).collect()} == {1, 2}


def test_empty(spark):
    arc, out = shared_path(spark, "tests", "arc"), shared_path(spark, "tests", "warc")
    W.write_arc(spark.createDataFrame([], "page_id bigint, url string, html string"), arc)
    W.write_warc(W.convert(W.read_arc(spark, arc)), out)
    assert W.read_warc(spark, out).where("record_type <> 'warcinfo'").count() == 0


def arc(version, *records):
    about = f"{version} 0 x\n{W.LAYOUT[version]}\n".encode()
    tail = b"" if version == 1 else b" 200 - - 0 f"
    lines = [(b"filedesc://f 0.0.0.0 20010203040506 text/plain" + tail, about), *records]
    return b"\n".join(head + b" %d\n" % len(doc) + doc for head, doc in lines) + b"\n"


def test_versions_lines_and_members():
    http = b"HTTP/1.0 200 OK\nA: b\n\nbody\n\nmore"
    one = arc(1, (b"http://a/b c 1.2.3.4 20010203040506 text/html", http), (b"dns:a 1.2.3.4 20010203040506 text/dns", b"a. 1 IN A 1.2.3.4"))
    r = list(W.arc_records(one))
    assert [x["URL"] for x in r] == ["filedesc://f", "http://a/b c", "dns:a"] and W.http_parts(r[1]["doc"]) == (b"HTTP/1.0 200 OK\nA: b\n\n", b"body\n\nmore")
    assert W.http_parts(r[2]["doc"]) == (b"", b"a. 1 IN A 1.2.3.4")
    two = arc(2, (b"http://a/ 1.2.3.4 20010203040506 text/html 200 - - 99 f", http))
    assert list(W.arc_records(two))[1]["version"] == 2
    assert W.unzipped(gzip.compress(one[:50]) + gzip.compress(one[50:])) == one == W.unzipped(one)


@pytest.mark.parametrize("data", [arc(1)[:-9], b"http://a 1 2 3 4\n", arc(1) + b"x 1 2\n", arc(1) + b"http://a 1.2.3.4 2001 text/html 9999\nshort\n", arc(1) + b"no end"])
def test_broken_archives_raise(data):
    with pytest.raises(ValueError):
        list(W.arc_records(data))
    with pytest.raises(ValueError):
        W.unzipped(gzip.compress(data)[:-4])


def test_broken_warc_raises():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(W.warc_records(good * 2))[1][1] == b"abc"
    for bad in (good[:-1], good.replace(b": 3", b": 4"), b"x" + good):
        with pytest.raises(ValueError):
            list(W.warc_records(bad))
