"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import lexical

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score), every document scored."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    count, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in bags:
            m = 25 + 75 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def got(df):
    return sorted(map(str, map(tuple, df.collect())))


def wanted(*args, **kw):
    return sorted(map(str, plain(*args, **kw)))


def test_all_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, queries = ([tuple(r) for r in x.collect()] for x in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    expected = wanted(rows, queries)
    assert got(lexical.rank(docs, items)) == expected
    assert got(lexical.rank(docs.repartition(7), items, part_bytes=2000, leaf=1)) == expected


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_ties_and_few_words(spark, leaf):
    """A vocabulary of six words, so that many documents tie; a third are one text."""
    rng = random.Random(5)
    docs = [(i, "a b c" if i % 3 == 0 else " ".join(rng.choices("abcdef", weights=[9, 5, 3, 2, 1, 1], k=rng.randrange(0, 12)))) for i in range(400)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices("abcdefg", k=rng.randrange(0, 9)))) for i in range(30)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.rank(df, it, leaf=leaf)) == wanted(docs, items)
    assert got(lexical.rank(df, it, k=3, leaf=leaf)) == wanted(docs, items, k=3)


def test_odd_rows(spark):
    docs = [(1, "Ünder the TREE, x1 x1"), (1, "Ünder the TREE, x1 x1"), (None, "tree"), (2, None), (3, ""), (4, "... --"), (5, "word " * 300_000), (None, "tree the")]
    items = [(7, "tree the tree"), (7, "tree the tree"), (None, "Ünder"), (8, None), (9, "!?"), (10, "absent"), (11, "word x1")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, number int, score string")
    it = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.rank(df, it)) == wanted(docs, items)
    assert lexical.rank(df.limit(0), it).count() == 0 and lexical.rank(df, it.limit(0)).count() == 0
    assert lexical.rank(df.where("doc_id in (2, 3, 4)"), it).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 70, 3, 33])
    impact = rng.integers(0, 50, lengths.sum())
    shard = lexical.Shard(np.arange(4), lengths, np.concatenate([np.arange(n) for n in lengths]), impact, 70)
    for _ in range(300):
        i = rng.integers(0, 4)
        a, b = sorted(rng.integers(shard.begin[i], shard.end[i] + 1, 2))
        assert shard.highest(np.array([a]), np.array([b]))[0] == max(impact[a:b], default=0)


def test_search_leaves_most_documents_out():
    """One list of clearly different impacts: the best are found without scoring the rest."""
    n = 5000
    impact = np.random.default_rng(1).permutation(n) + 1
    shard = lexical.Shard(np.arange(1), np.array([n]), np.arange(n), impact, n)
    read = []
    highest = shard.highest
    shard.highest = lambda a, b: read.append(1) or highest(a, b)
    best = shard.search(np.array([0]), np.array([1]), list(range(n)), [], 10, 1)
    assert [-s for s, _, _ in best] == list(range(n, n - 10, -1)) and len(read) < 60
