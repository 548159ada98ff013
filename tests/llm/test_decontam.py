"""Decontamination against a window by window search."""

import re

import numpy as np
import pytest

from ledgerlens.llm import decontam
from ledgerlens.llm.bytewords import LOWER, hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p:p + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                owners = windows.get(tuple(w[p:p + k]))
                if owners:
                    hit.update(range(p, p + k))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    for r in rows:
        spans = np.array(r["hit_spans"]).reshape(-1, 2)
        assert (spans[:, 1] - spans[:, 0]).sum() == r["n_hit"]
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows], key=str)


def random_case(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["ab", "cd", "Éf", "g1", "漢", "hh", "zz"]
    items = [(int(i), " ".join(rng.choice(vocabulary[:5], rng.integers(0, 9)))) for i in range(12)]
    docs = [(int(i), ", ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("seed, window, part", [(0, 3, 1 << 24), (1, 4, 40), (2, 2, 1 << 24), (3, 5, 25)])
def test_against_plain_search(spark, seed, window, part):
    docs, items = random_case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontam.find(d, b, window=window, part_bytes=part)) == plain(docs, items, window)


def test_all_documents(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    wanted = plain(docs, items)
    assert found(decontam.find(d, b)) == wanted
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in wanted if not w[2]}


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None, 5), (2, "", 5), (None, f"x {passage} y", 5), (3, passage.upper(), 5), (3, passage.upper(), 5),
            (4, ("w1 w2 " * 400_000) + passage, 5), (5, "one two", 5), (6, "a" * 1_500_000 + " one Two", 5)]
    items = [(7, passage), (8, None), (9, "..."), (10, "One two"), (11, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit long")
    b = spark.createDataFrame(items, "item_id long, text string")
    df = decontam.find(d, b)
    assert found(df) == plain([r[:2] for r in docs], items)
    best = {r["doc_id"]: (r["longest_words"], r["longest_at"], r["longest_item"]) for r in df.collect()}
    assert best[None][:2] == (30, 1) and best[4][:2] == (30, 800_000) and best[5] == (2, 0, 10) and best[1] == (0, None, None)
    assert decontam.clean(d, b).columns == ["doc_id", "text", "n_hit"]
    assert decontam.find(d.limit(0), b).count() == 0
    assert found(decontam.find(d, b.limit(0))) == plain([r[:2] for r in docs], [])


def test_hashes_do_not_depend_on_place():
    data = LOWER[np.frombuffer(b"ab xx" + b"q" * 1_100_000 + b" AB xx" + b"Q" * 1_100_000, np.uint8)]
    start = np.array([0, 3, 1_100_006, 1_100_009])
    end = np.array([2, 1_100_005, 1_100_008, len(data)])
    h = hashes(data, start, end)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
