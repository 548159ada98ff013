"""Language identification: automata by definition, phrases by brute force, held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa

from ledgerlens.llm import langid
from ledgerlens.llm.common import utf8

SF = "/root/testdata/sf0.01"


def plain_phrases(text, sample):
    """Greedy longest phrases by substring search, cut after every stretch."""
    count = 0
    for a in range(0, len(text), langid.STRETCH):
        part, i = text[a:a + langid.STRETCH], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i:i + k + 1] in sample:
                k += 1
            count += 1
            i += k
    return count


def test_phrases():
    rng = random.Random(4)
    samples = {"a": bytes(rng.choice(b"abcd ") for _ in range(700)), "b": bytes(rng.choice(b"aabx ") for _ in range(300))}
    model = langid.Model(samples)
    many = ["".join(rng.choice("abcxy ") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 1000)]
    folded, bounds = langid.symbols(*utf8(pa.array(many)))
    got = model.phrases(model.code[folded], bounds)
    for i in range(len(many)):
        own = folded[bounds[i]:bounds[i + 1]].tobytes()
        assert got[i].tolist() == [plain_phrases(own, samples["a"]), plain_phrases(own, samples["b"])]


def test_automaton_has_exactly_the_substrings():
    step = langid.automaton(b"abcbcab")
    parts = {b"abcbcab"[i:j] for i in range(7) for j in range(i + 1, 8)}
    found, todo = set(), [(0, b"")]
    while todo:
        s, w = todo.pop()
        for c, to in step[s].items():
            found.add(w + bytes([c]))
            todo.append((to, w + bytes([c])))
    assert found == parts


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(known)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat " * 30, "en"), (2, "le chat est sur la table " * 30, "fr"), (3, None, "en"), (4, "", None),
            (None, "123 !!", "fr"), (5, "the mat " * 300_000, None), (6, "LE CHAT", None), (6, "LE CHAT", None), (7, "漢字", None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, score int")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()]
    held = [d for d, _, lang in rows if lang and d is not None and zlib.crc32(str(d).encode()) % 4 == 2]
    assert not {1, 2} & set(held)
    assert got[:8] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (None, "und"), (5, "en"), (6, "fr"), (6, "fr")]
    assert got[8][1] in ("en", "fr")
    nothing = langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 0)).where("lang is null")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_long_texts_and_copies_teach(spark):
    """A language that occurs in long texts only, and one of whose texts most are copies."""
    rows = [("the cat sat on the mat and slept there " * 900, "en")] + [("zzz yyy xxx " * 40, "fr")] * 60
    rows += [(f"le chat numéro {i} est sur la table et il dort " * 30, "fr") for i in range(10)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_docs=1000, sample_symbols=9000)
    assert model.languages == ["en", "fr"]
    names, _ = model.predict(["the cat slept on the mat", "le chat est sur la table et il dort"])
    assert names == ["en", "fr"]
