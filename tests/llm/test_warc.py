import gzip
import hashlib

import pytest

from scimetrics.llm import warc
from scimetrics.session import new_path

LONG = "<p>é😀\r\n\r\nWARC/1.1\r\n" * 20
PAGES = [
    (7, "http://a.example/x y", LONG),
    (3, "http://b.example/", LONG),
    (9, None, LONG),
    (4, "http://c.example/", "short"),
    (5, "http://c.example/2", "short"),
    (6, "http://c.example/3", None),
    (8, "http://c.example/4", ""),
    (10, "u", "x" * 100),
    (11, "u", "x" * 100),
    (12, "u", "x" * 99),
    (13, "u", "x" * 99),
    (14, "u", "y" * 6_000_000),
    (15, "filedesc://segment.arc", "1 0 x\nURL Archive-length\n"),
    (16, "filedesc://Home", None),
    (None, "n", LONG),
    (10, "u", "x" * 100),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.archive(df).collect()
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(page_id, first.get(html, page_id))
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        old = page_id is not None and first.get(html, page_id) < page_id
        want.append(
            (page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if old else "response", first[html] if old else None)
        )
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert all(r.intact for r in got)


def test_archives_hold_the_bytes(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(df.repartition(3), arc)
    rows = warc.read_arc(spark, arc).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted((p[2] or "").encode() for p in PAGES)
    warc.convert(spark, arc, out)
    files = spark.read.format("binaryFile").load(out).collect()
    records = [r for f in files for r in warc.warc_records(bytes(f.content))]
    assert len(records) == len(PAGES)
    for headers, block in records:
        assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["warc-record-id"].startswith("<urn:uuid:") and headers["warc-date"].endswith("Z")
    ids = {h["warc-record-id"] for h, _ in records if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in ids for h, _ in records if h["warc-type"] == "revisit")


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_and_members(version):
    parts = [warc._arc_head(version), *[warc._arc_record(version, i, "http://x/", "body\n\n" * i, 0) for i in range(5)]]
    content = b"".join(gzip.compress(p) for p in parts)
    got = list(warc.arc_records(content))
    assert [r["payload"] for r in got] == [b"body\n\n" * i for i in range(5)]
    assert got[2]["date"] == "1997-01-01T00:00:02Z" and got[2]["page_id"] == 2
    with pytest.raises(ValueError, match="declared length"):
        list(warc.arc_records(gzip.compress(b"".join(parts)[:-5])))


def test_the_definition_line_counts_and_checksums_must_agree():
    body = b"1 1 x\nURL Content-type IP-address Archive-date Archive-length\n"
    head = b"filedesc://a 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body + b"\n"
    got = list(warc.arc_records(gzip.compress(head + b"http://x/ text/html 1.2.3.4 19990101000000 3\nabc\n")))
    assert [(r["url"], r["ip"], r["payload"]) for r in got] == [("http://x/", "1.2.3.4", b"abc")]
    record = warc._arc_record(2, 1, "http://x/", "body", 0).replace(b"body", b"bodi")
    with pytest.raises(ValueError, match="checksum"):
        list(warc.arc_records(gzip.compress(warc._arc_head(2) + record)))


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
