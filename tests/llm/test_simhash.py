"""SimHash groups against a comparison of all pairs."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    distinct = sorted(set(prints.values()))
    values = np.array(distinct, np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    place = {v: find(i) for i, v in enumerate(distinct)}
    for d, p in prints.items():
        least[place[p]] = min(d, least.get(place[p], d))
    return {d: least[place[p]] for d, p in prints.items()}


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    wanted = plain_components(prints)
    rows = simhash.groups(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
    stay = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert stay == set(wanted.values())


def test_links_of_close_fingerprints(spark):
    """Chains, hubs and a crowd of neighbours, in ordinary and in crowded groups."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    near = []
    for b in base:
        x = b
        for _ in range(20):
            x = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64))
            near.append(x)
    values = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    prints = {i: int(v) for i, v in enumerate(values)}
    wanted = plain_components(prints)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    number = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    for hot in (1 << 14, 2):
        found = {number[r["node"]]: number[r["root"]] for r in simhash.components(simhash.links(df, hot_rows=hot)).collect()}
        classes = {}
        for i in prints:
            classes.setdefault(found.get(i, i), []).append(i)
        assert sorted(map(tuple, classes.values())) == sorted(
            tuple(i for i in prints if wanted[i] == r) for r in set(wanted.values()))


def test_counters():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 62, 200, dtype=np.int64).astype(np.uint64)
    rows[50:150] = rows[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in range(8):
        alive, mask = simhash._near(np.repeat(rows[:3], 4), np.tile(np.arange(4), 3), simhash.transpose(rows), radius)
        got = np.zeros((12, 64), bool)
        got[alive] = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros(256, np.uint64)
        padded[:200] = rows
        assert (got.reshape(3, 256) == (np.bitwise_count(rows[:3, None] ^ padded) <= radius)).all()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c", None), (3, "a b c", None), (None, "a b c", "y"), (4, "A\tB  c\n", "z"),
            (5, "w " * 300_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r["doc_id"], r["fingerprint"] == 0, r["component_id"]) for r in simhash.groups(docs).collect()}
    assert {(1, True, 1), (2, True, 1), (3, False, 3), (None, False, 3), (4, False, 3)} <= got
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select(F.coalesce("doc_id", F.lit(0))).toPandas().iloc[:, 0]) == [0, 1, 3, 5]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_pieces_of_a_long_text():
    text = b" ".join(b"w%d" % (i % 977) for i in range(5000))
    whole = np.concatenate(list(simhash._shingle_hashes(text, 4)))
    cut = np.concatenate(list(simhash._shingle_hashes(text, 4, piece=100)))
    assert (whole == cut).all() and len(whole) == 4997


def test_repeated_ids_with_different_texts(spark):
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "uno dos tres cuatro cinco seis")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (5, c), (5, c)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicated(docs).collect())) == sorted([(1, a), (5, b), (5, c)])
