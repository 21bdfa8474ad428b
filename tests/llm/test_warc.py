import gzip
import hashlib
import os

import pytest

from loomgrid.llm.queries import op6_warc_archives
from loomgrid.llm.warc import plan_records, read_archives, write_archives

BIG = "<p>" + "x" * 1200
PAGES = [(1, "http://a.example/", BIG), (5, "http://b.example/", BIG), (3, None, BIG), (2, "u", "small"), (4, "u", "small"), (6, "u\r\nWARC-Type: x", None), (7, "é", "é" * 600), (8, "e", "é" * 600), (9, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (10, "long", "y" * 3_000_000)]


def expected(pages):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "")]
        to = max(same) if len(raw) >= 1000 and max(same) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    return sorted(out)


def test_query(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op6_warc_archives(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected(PAGES)


def test_round_trip_and_push_down(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    written = write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2), folder, index_every=1000)
    assert written.agg({"records": "sum"}).first()[0] == len(PAGES)
    whole = read_archives(spark, folder, split_bytes=500)
    assert whole.rdd.getNumPartitions() >= 2
    texts = {r.page_id: r.payload for r in whole.where("record_type = 'response'").collect()}
    assert texts[9] == PAGES[8][2] and texts[10] == PAGES[9][2] and texts[8] == "é" * 600 and 7 not in texts
    assert whole.where("record_type = 'warcinfo'").count() >= 1
    plan = read_archives(spark, folder, ["page_id", "record_type"]).where("record_type = 'revisit'")
    assert {r.page_id for r in plan.collect()} == {1, 3, 7}
    assert read_archives(spark, folder, ["page_id", "target_uri"]).where("target_uri = 'u'").count() == 2
    assert read_archives(spark, folder).where("page_id in (1, 10)").count() == 2
    assert read_archives(spark, folder).where("payload like 'y%'").count() == 1
    with pytest.raises(Exception):
        read_archives(spark, folder, ["nothing"]).count()


def test_edges(spark, tmp_path):
    rows = [(None, "u", BIG, 1), (1, "u", BIG, 1), (1, "u", BIG, 1), (None, None, None, 1)]
    folder = f"{tmp_path}/e"
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), folder)
    got = read_archives(spark, folder, ["page_id", "record_type", "refers_to"]).where("record_type <> 'warcinfo'").collect()
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 1) == [("response", None)] * 2
    assert sorted(((r.record_type, r.refers_to) for r in got if r.page_id is None), key=str) == [("response", None), ("revisit", 1)]
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0


def test_members(spark, tmp_path):
    folder = f"{tmp_path}/gz"
    write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2), folder, members=True)
    archives = [f for f in os.listdir(folder) if f.endswith(".warc.gz")]
    assert archives and gzip.open(f"{folder}/{archives[0]}").read().startswith(b"WARC/1.1")
    texts = {i: h or "" for i, _, h in PAGES}
    whole = lambda **o: {r.page_id: r.payload for r in read_archives(spark, folder, ["page_id", "payload", "record_type"], **o).where("record_type = 'response'").collect()}
    first = whole(split_bytes=300, verify="true")
    assert first == {i: texts[i] for i in first} and set(texts) - set(first) == {1, 3, 7}
    for f in archives:  # without an index members are inflated to their ends
        os.remove(f"{folder}/{f}.idx")
    assert whole() == first
    assert read_archives(spark, folder, ["page_id", "target_uri"]).where("target_uri = 'u'").count() == 2


def test_unwanted_blocks_are_not_decoded(spark, tmp_path):
    folder = f"{tmp_path}/skip"
    write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), folder)
    archive = next(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".warc"))
    raw = open(archive, "rb").read()
    spoilt = raw.replace(gzip.compress(b"small", 1, mtime=0), b"!" * len(gzip.compress(b"small", 1, mtime=0)))
    assert spoilt != raw
    open(archive, "wb").write(spoilt)
    assert read_archives(spark, folder, ["page_id", "payload_bytes"]).count() == len(PAGES) + 1
    assert read_archives(spark, folder, ["page_id", "payload"]).where("page_id = 10").count() == 1
    with pytest.raises(Exception):
        read_archives(spark, folder, ["page_id", "payload"]).where("page_id = 2").collect()


def test_verify_tells_of_a_spoilt_payload(spark, tmp_path):
    folder = f"{tmp_path}/v"
    write_archives(spark.createDataFrame(PAGES[3:5], "page_id long, url string, html string").coalesce(1), folder, members=False)
    archive = next(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".warc"))
    raw = open(archive, "rb").read()
    open(archive, "wb").write(raw.replace(gzip.compress(b"small", 1, mtime=0), gzip.compress(b"smell", 1, mtime=0), 1))
    assert read_archives(spark, folder, ["page_id"]).count() == 3
    with pytest.raises(Exception, match="digest differs"):
        read_archives(spark, folder, ["page_id"], verify="true").collect()


def test_many_groups_go_by_a_filter(spark):
    rows = [(i, "u", f"{i % 50} " * 800 if i < 300 else f"own {i} " * 200, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    key = lambda r: (r.id, r.kind, r.refers_to)
    few, many = (sorted(map(key, plan_records(df, broadcast=n).collect())) for n in (1000, 0))
    assert few == many and sum(k == "revisit" for _, k, _ in few) == 250


def foreign(n, body, head):
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
    fields = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return fields.encode() + block + b"\r\n\r\n"


def test_several_records_in_a_member(spark, tmp_path):
    whole = [foreign(n, f"text {n}".encode() * (1 if n != 3 else 300_000), b"X: y") for n in range(6)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(whole[:5])) + gzip.compress(whole[5]))
    read = lambda columns: read_archives(spark, str(tmp_path), columns)
    assert {r.page_id for r in read(["page_id"]).collect()} == set(range(6))
    assert {r.page_id: r.payload for r in read(["page_id", "payload"]).collect()} == {n: f"text {n}" * (1 if n != 3 else 300_000) for n in range(6)}
    assert [r.payload for r in read(["page_id", "payload"]).where("page_id = 4").collect()] == ["text 4"]


def test_bodies_in_chunks_and_codings(spark, tmp_path):
    import zlib

    chunks = lambda b: b"".join(f"{len(b[k : k + 7]):x};q=1\r\n".encode() + b[k : k + 7] + b"\r\n" for k in range(0, len(b), 7)) + b"0\r\n\r\n"
    text = "héllo wörld, again and again".encode()
    raw = zlib.compressobj(wbits=-15)
    told = [
        (text, b"Server: x"),
        (chunks(text), b"Transfer-Encoding: chunked"),
        (chunks(gzip.compress(text)), b"transfer-encoding: Chunked\r\nContent-Encoding: gzip"),
        (zlib.compress(text), b"Content-Encoding: deflate"),
        (raw.compress(text) + raw.flush(), b"Content-Encoding: deflate"),
        (gzip.compress(zlib.compress(text)), b"Content-Encoding: deflate, x-gzip"),
        (text, b"Content-Encoding: identity"),
        (text, b"Content-Encoding: br"),
    ]
    (tmp_path / "b.warc").write_bytes(b"".join(foreign(n, body, head) for n, (body, head) in enumerate(told)))
    got = {r.page_id: r.payload for r in read_archives(spark, str(tmp_path), ["page_id", "payload"], verify="true").collect()}
    assert got == dict.fromkeys(range(len(told)), text.decode())
