import gzip
import hashlib
from base64 import b32encode

from corpus import clashing, rows

from txnrisk.llm import warc_store as ws

SCHEMA = "page_id long, url string, html string"
BIG = "é日😀" * 200_000
PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://c/\r\nX: y", None),
         (5, "http://d/", ""), (6, "http://e/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", BIG), (8, "u", BIG + "!"),
         (1, "http://b/", "<p>same</p>"), (1, "http://b/", "<p>other</p>"), (None, "n", "<p>same</p>"), (None, "n", "<p>alone</p>")]


def expected(pages, least=0):
    data = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, d in data:
        if i is not None and len(d) >= least:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, d in data:
        again = i is not None and d in first and i > first[d]
        out.append((i, len(d), b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    for pages in (df, clashing(df).repartition(5)):
        for least in (0, 5):
            got = ws.records(ws.read_archives(ws.write_archives(pages, least=least)))
            assert rows(got) == expected(PAGES, least)


def test_chunks_carry_running_digests(spark):
    chunks = ws.read_archives(ws.write_archives(spark.createDataFrame(PAGES, SCHEMA)))
    got = sorted((r.chunk_no, bytes(r.chunk), r.digest) for r in chunks.filter("record_id = '<urn:page:8>'").collect())
    assert len(got) > 3 and all(len(c) <= ws.CHUNK_BYTES for _, c, _ in got)
    data = b"".join(c for _, c, _ in got)
    assert data == (BIG + "!").encode()
    seen = 0
    for _, c, digest in got:
        seen += len(c)
        assert digest == b32encode(hashlib.sha1(data[:seen]).digest()).decode()


def test_files_are_warc(spark):
    manifest = ws.write_archives(spark.createDataFrame(PAGES[:3], SCHEMA))
    text = b"".join(gzip.open(r.path).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 3 and text.count(b"WARC-Type: revisit") == 2
    assert b"WARC-Refers-To: <urn:page:1>" in text


def test_empty_table(spark):
    assert rows(ws.records(ws.read_archives(ws.write_archives(spark.createDataFrame([], SCHEMA))))) == []
