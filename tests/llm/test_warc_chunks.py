import base64
import gzip
import hashlib

import pytest

from bankspark.llm.warc_chunks import read_back, read_chunks, write_warc


def brute(rows):
    first = {}
    for page, _, html, *_ in rows:
        h = html or ""
        if page is not None:
            first[h] = min(first.get(h, page), page)
    times = {}
    for _, _, html, *_ in rows:
        times[html or ""] = times.get(html or "", 0) + 1
    out = []
    for page, _, html, *_ in rows:
        h = html or ""
        to = first.get(h) if times[h] > 1 and first.get(h) != page else None
        out.append((page, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


ROWS = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (8, "u\r\nx y", ""), (None, "n", "<p>x</p>"),
        (None, "n", "only"), (12, "é", "ünï\r\n\r\nWARC/1.1\r\n"), (13, "big", "0123456789é" * 400000), (14, "big", "0123456789é" * 400000), (15, "s", "solo")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, first string, digest int")


def test_round_trip(spark):
    assert sorted((tuple(r) for r in read_back(frame(spark, ROWS)).collect()), key=repr) == brute(ROWS)
    assert read_back(frame(spark, ROWS).limit(0)).collect() == []
    small = sorted((tuple(r) for r in read_back(frame(spark, ROWS), least_bytes=9).collect()), key=repr)
    assert [r[0] for r in small if r[3] == "revisit"] == [14]


def test_on_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((tuple(r) for r in read_back(pages.union(pages.limit(20).selectExpr("page_id + 100000", "url", "html"))).collect()), key=repr) == brute(
        rows + [(p + 100000, u, h) for p, u, h in [tuple(r) for r in pages.limit(20).collect()]])


def test_chunks_and_files(spark, tmp_path):
    manifest = write_warc(frame(spark, ROWS).coalesce(1), folder=str(tmp_path / "w"), file_bytes=1000)
    rows = manifest.collect()
    assert len(rows) > 2 and sum(r.records for r in rows) == len(ROWS)
    chunks = read_chunks(manifest, chunk=65536).collect()
    big = sorted((r for r in chunks if r.page_id == 13), key=lambda r: r.chunk_no)
    payload = ("0123456789é" * 400000).encode()
    assert b"".join(r.data for r in big) == payload and max(len(r.data) for r in big) <= 65536
    assert [r.chunk_no for r in big] == list(range(len(big))) and [r.last for r in big] == [False] * (len(big) - 1) + [True]
    for r in (big[0], big[3], big[-1]):
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(payload[: r.bytes_so_far]).digest()).decode()
    text = b"".join(gzip.open(r.path).read() for r in rows)
    assert text.count(b"WARC-Type: ") == len(ROWS) and b"u%0D%0Ax%20y" in text


def test_damage_is_an_error(spark, tmp_path):
    manifest = write_warc(frame(spark, ROWS[:2]), folder=str(tmp_path / "w"))
    path = manifest.first().path
    data = gzip.open(path).read()
    for bad in (data.replace(b"<p>x</p>", b"<p>y</p>"), data[:-6]):
        with gzip.open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="digest|ends within"):
            read_chunks(manifest).collect()
