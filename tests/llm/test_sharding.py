"""Sharding: sizes, order and mixture of every shard."""

import hashlib
import zlib
from collections import Counter

from ledgerlens.llm import sharding

SF = "/root/testdata/sf0.001"


def check(rows, got, shards):
    n = len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted(r["position"] for r in got) == list(range(n))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(k))
    total = Counter(r["source"] for r in got)
    for source, t in total.items():
        for s, k in sizes.items():
            share = sum(r["source"] == source for r in got if r["shard"] == s)
            assert abs(share - k * t / n) < 2.5, (source, s)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = sharding.interleave(docs, 24).collect()
    check(rows, got, 24)
    # order by brute force
    rank = {}
    for d, _, s in sorted(rows, key=lambda r: (r[2], hashlib.md5(f"42:{r[0]}".encode()).hexdigest())):
        rank.setdefault(s, []).append(d)
    order = sorted(((i + 0.5) / len(ds), hashlib.md5(f"42:{d}".encode()).hexdigest(), d) for ds in rank.values() for i, d in enumerate(ds))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == [d for *_, d in order]


def test_odd_rows(spark):
    rows = [(1, "a", "s")] * 40 + [(None, None, None)] * 30 + [(i, "x" * i, "t") for i in range(10)] + [(5, "", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, position int")
    check(rows, sharding.interleave(docs, 7).collect(), 7)
    few = sharding.interleave(docs.limit(3), 24).collect()
    assert len(few) == 3 and {r["slot"] for r in few} == {0}
    assert sharding.interleave(docs.limit(0), 24).count() == 0
