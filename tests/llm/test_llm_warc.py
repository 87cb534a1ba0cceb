"""WARC archives: pages against plain Python after a round trip, faults, foreign archives."""

import gzip
import hashlib
import random

import pytest

from trustmill.llm import queries, warc


def expected(pages):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, for distinct rows."""
    least, out = {}, []
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100:
            least[data] = min(least.get(data, (True, 0)), (page_id is None, page_id or 0))
    for page_id, _, html in pages:
        data = (html or "").encode()
        first = least.get(data, (page_id is None, page_id or 0))
        revisit = first != (page_id is None, page_id or 0)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[1] if revisit else None))
    return sorted(out, key=str)


def test_query_on_a_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    got = [tuple(r)[:5] for r in queries.op11_warc_reassembly(spark, sf_dir).collect()]
    assert sorted(got, key=str) == expected(pages)


@pytest.mark.parametrize(("segment", "records"), [(1 << 20, 50_000), (700, 2)])
def test_round_trip_of_odd_pages(spark, tmp_path, segment, records):
    r = random.Random(1)
    same = "<p>the same</p>" * 20
    pages = [(1, None, None), (2, "http://a.b/ c\r\nX: y", ""), (3, "u", "a" * 99), (4, "u", "a" * 99), (5, "u", "b" * 100), (6, "u", "b" * 100), (None, "n", same), (9, "é日", same), (8, "v", same), (10, "w", "é日本\r\n\r\nWARC/1.1\r\n0\r\n" * 9000), (11, "w", "".join(chr(r.randint(1, 0x2FFF)) for _ in range(5000)))]
    pages += [(100 + k, "hot", "hot page " * 50) for k in range(300)]
    repeated = [(7, "u", "long one " * 500)] * 3
    df = spark.createDataFrame([(*p, "r", 1) for p in pages + repeated], "page_id long, url string, html string, record_id string, first int")
    path = f"file://{tmp_path}/w"
    warc.write(df.repartition(3), path, segment_bytes=segment, records=records)
    found = warc.read(spark, path, payloads=True)
    rows = found.collect()
    assert all(x["fault"] is None for x in rows)
    got = sorted([(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to_page"]) for x in rows], key=str)
    assert got == expected(pages + repeated)
    by_id = {p[0]: (p[2] or "").encode() for p in pages + repeated}
    assert all(x["payload"] == by_id[x["page_id"]] for x in rows)
    assert [x.url for x in rows if x.page_id == 2] == ["http://a.b/%20c%0D%0AX:%20y"]


def archive(tmp_path, records, name="x.warc.gz", members=True):
    """Records as members of a gzip file, or plain."""
    data = [x + b"\r\n\r\n" for x in records]
    (tmp_path / name).write_bytes(b"".join(map(gzip.compress, data)) if members else b"".join(data))
    return f"file://{tmp_path}/{name}"


def segments(html, size=400, page=5):
    return list(warc.page_records({"page_id": page, "url": "u", "record_id": f"id{page}", "digest": hashlib.sha256(html).hexdigest(), "refers_to": None, "body": html}, size))


def read(spark, path):
    return [(x["page_id"], x["payload_bytes"], x["fault"]) for x in warc.read(spark, path).collect()]


def test_foreign_archives(spark, tmp_path):
    """Members for each record, records without pages, plain bodies, chunk extensions and trailers, segments in another order."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a%d>\r\nContent-Length: %d\r\n\r\n%b"
    plain = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=1\r\nabc\r\n0A\r\n0123456789\r\n0\r\nT: u\r\n\r\n"
    parts = segments(b"z" * 3000)
    assert len(parts) > 5
    path = archive(tmp_path, [info, head % (1, len(plain), plain), head % (2, len(chunked), chunked), *parts[::-1]])
    rows = {x["record_id"]: x for x in warc.read(spark, path, payloads=True).collect()}
    assert bytes(rows["<a1>"]["payload"]) == b"body"
    assert bytes(rows["<a2>"]["payload"]) == b"abc0123456789"
    assert rows["<urn:uuid:id5>"]["payload_bytes"] == 3000
    assert {x["fault"] for x in rows.values()} == {None}


def test_faults_are_told(spark, tmp_path):
    parts = segments(b"q" * 3000)
    cases = {
        "gap": ([parts[0], *parts[2:]], "segment 2 is missing"),
        "start": (parts[1:], "segment 1 is missing"),
        "end": (parts[:-1], "the last segment is missing"),
        "length": ([*parts[:-1], parts[-1].replace(b"Total-Length: 3", b"Total-Length: 4")], "segments add up"),
        "twice": ([*parts, parts[2].replace(b"qqq", b"qqx")], "segment 3 is there twice"),
        "digest": ([x.replace(b"qqq", b"qqx") for x in parts], "the digest is another one"),
        "cut": ([segments(b"q" * 90, 1 << 20)[0][:-20]], "the record ends early"),
    }
    for name, (records, fault) in cases.items():
        got = read(spark, archive(tmp_path, records, f"{name}.warc", members=name == "gap"))
        assert len(got) == 1 and fault in got[0][2], (name, got)
    bad = segments(b"q" * 90, 1 << 20)[0]
    assert "no size" in read(spark, archive(tmp_path, [bad.replace(b"5a\r\n", b"zz\r\n")], "size.warc"))[0][2]
    revisit = next(warc.page_records({"page_id": 6, "url": "u", "record_id": "r", "digest": "0", "refers_to": "gone", "body": None}))
    assert read(spark, archive(tmp_path, [revisit], "revisit.warc")) == [(6, None, "what it refers to is missing")]


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0
