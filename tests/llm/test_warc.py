"""Archives: round trips through the index, duplicates, odd rows."""

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc

SF = "/root/testdata/sf0.001"


def wanted(rows):
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h] = max(p, last.get(h, p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        head = last.get(h) if len(data) >= 1000 and sum(x[2] == h for x in rows) > 1 else None
        again = head is not None and head != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def result(spark, rows, folder=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    folder = warc.archive(pages, folder)
    got = warc.fetch(warc.captures(pages), folder).drop("url", "payload").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, got.collect()), key=str), folder


def test_odd_rows(spark, tmp_path):
    big = "ä" * 700
    rows = [(1, "http://a.example/x", big), (2, "http://a.example/x", big), (3, None, big), (None, "https://b.example", big),
            (4, "http://c.example/\r\nX: y", None), (5, "not a url", ""), (6, "http://a.example/x", "short"),
            (7, "http://a.example/x", "short"), (None, None, None), (8, "http://d.example", "y" * 3_000_000)]
    got, folder = result(spark, rows, str(tmp_path / "w"))
    assert got == wanted(rows)
    # the files are ordinary WARC files: members on end, each a record
    texts = [gzip.open(f).read() for f in glob.glob(f"{folder}/records/*.warc.gz")]
    assert sum(t.count(b"WARC/1.1\r\n") for t in texts) == len(rows)
    assert sum(t.count(b"WARC-Type: revisit") for t in texts) == 3


def test_repeated_rows_and_many_captures_of_one_url(spark):
    rows = [(i // 2, "http://hot.example/", "z" * 1200 if i % 3 else f"page {i}") for i in range(400)]
    got, folder = result(spark, rows)
    hot = max(p for p, _, h in rows if h[0] == "z")
    assert len(got) == len(rows)
    assert {r[4] for r in got} == {None, hot}
    some = spark.createDataFrame([("example,hot)/", 7), ("example,hot)/", 10_000), ("nothing", 1)], "key string, capture long")
    assert [r["page_id"] for r in warc.fetch(some, folder).collect()] == [7, 7]


def test_small_blocks(spark, tmp_path):
    """Blocks of a few lines: every capture is found, whichever block it is in."""
    rows = [(i, f"http://h{i % 7}.example/{i // 40}", f"p{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    places = warc.write(warc.decide(pages), f"{tmp_path}/records")
    warc.build_index(places, f"{tmp_path}/index", lines=3)
    assert spark.read.parquet(f"{tmp_path}/index/directory").count() >= 100
    found = warc.look_up(warc.captures(pages), f"{tmp_path}/index")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, places.collect()))


def test_empty(spark):
    assert result(spark, [])[0] == []


@pytest.mark.parametrize("url, key", [
    ("https://user@www.Blog.example.com:443/a/B?q=1#top", "com,example,blog)/a/B?q=1"), ("http://example.org", "org,example)/"),
    ("http://example.org?x", "org,example)/?x"), ("nothing", "nothing)/"), (None, ""), ("http://a.b/x y\t", "b,a)/x%20y")])
def test_keys(spark, url, key):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.reversed_host_key(F.col("u"))).head()[0] == key


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    assert result(spark, rows)[0] == wanted(rows)


def test_damaged_payload():
    data = bytearray(warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), "response", None, "1970-01-01T00:00:00Z"))
    assert warc.parse(bytes(data))["payload"] == b"abc"
    data[data.rindex(b"abc")] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(data))
