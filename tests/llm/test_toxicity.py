"""Toxicity: terms by definition, label model on drawn votes, held-out accuracy on planted words."""

import re
import zlib

import numpy as np
import pyarrow as pa

from ledgerlens.llm import toxicity
from ledgerlens.llm.bytewords import hashes
from ledgerlens.llm.common import utf8


def planted(n, seed=3):
    """Texts of random words; every eighth has one of a few planted words with some ending."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["".join(rng.choice(list("abdeghik"), 5)) for _ in range(400)])
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(vocabulary, rng.integers(5, 80)).tolist()
        bad = i % 8 == 0
        if bad:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["zorkul", "zorkab", "vexil", "Idiot"])))
        docs.append((i, " ".join(w), "x"))
        if i % 3:
            labels.append((i, int(bad)))
    return docs, labels


def test_terms():
    data, offsets = utf8(pa.array(["Abcdefg xy", None, "abcdé"]))
    owner, term = toxicity.term_hashes(data, offsets)
    raw = np.frombuffer(b"abcdefgxyabcd\xc3\xa9", np.uint8)
    wanted = set()
    for t, a, b in ((0, 0, 7), (0, 7, 9), (2, 9, 15)):
        for k, size in enumerate(toxicity.KINDS):
            if b - a >= size:
                h = hashes(raw, np.array([a]), np.array([a + size if size else b]))[0]
                wanted.add((t, int(h & ~np.uint64(3) | np.uint64(k))))
    assert set(zip(owner.tolist(), term.tolist())) == wanted


def test_label_model_recovers_rates_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.1
    votes = np.zeros((len(y), toxicity.VOTERS), bool)
    for k in range(5):
        votes[:, k] = rng.random(len(y)) < np.where(y, 0.7 - 0.1 * k, 0.01)
    votes[:, 5] = votes[:, 6] = votes[:, 0]  # one voter three times
    mask = votes @ (1 << np.arange(toxicity.VOTERS))
    pattern, count = np.unique(mask, return_counts=True)
    few = np.arange(len(y)) < 500  # labelled
    known = np.array([[np.sum(few & (y == c) & (mask == p)) for p in pattern] for c in (0, 1)], float)
    model = toxicity.LabelModel(pattern, count.astype(float), known)
    assert abs(model.prior - 0.1) < 0.05
    assert np.abs(model.rate[1][1:5] - [0.6, 0.5, 0.4, 0.3]).max() < 0.12
    assert model.correlation[0, 5] > 0.9 and model.weight[0] < 0.45 < model.weight[3]
    assert model.posterior(np.array([0]))[0] < 0.1 < 0.9 < model.posterior(np.array([0b11110]))[0]


def test_held_out_accuracy(spark):
    docs, labels = planted(4000)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    rows = toxicity.assess(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.3)
    right = [r["predicted"] == (r["doc_id"] % 8 == 0) for r in rows if r["held_out"]]
    assert np.mean(right) > 0.99


def test_odd_rows(spark):
    docs, labels = planted(600)
    docs += [(None, "zorkul", "x"), (10_001, None, "x"), (10_002, "", "x"), (10_003, "fine " * 400_000, "x"), (10_003, "fine", "x")]
    labels += [(None, 1), (5, None), (10_001, 0), (1, 0), (1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, held_out string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.assess(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[-5]["doc_id"] is None and not rows[-5]["held_out"] and rows[-4]["score"] == rows[-3]["score"] < 0.3
    for none in (lab.limit(0), lab.where("toxic = 0")):
        assert {r["score"] for r in toxicity.assess(d, none).collect()} == {0.0}
    assert toxicity.assess(d.limit(0), lab).count() == 0


def test_patterns():
    shut, stars = toxicity.PATTERNS[1], toxicity.PATTERNS[2]
    assert shut.search("oh Shut up now") and not re.search(shut, "shutter up")
    assert stars.search("what the f**k") and not stars.search("2 * 3")


def test_masked_words_without_a_star():
    none = np.zeros(0)
    lexicons = toxicity.Lexicons(none.astype(np.uint64), none, none, 0.1, 10)
    votes, _, _ = lexicons.bits(["such an a$$hole", "f#@k off", "oh sh!!t", "f**k", "nothing here", "c# and a@b"])
    assert [int(v) >> (toxicity.VOTERS - 1) & 1 for v in votes] == [1, 1, 1, 1, 0, 0]
