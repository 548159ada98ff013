"""BPE with word ends against the tokenizers library, on every character, random strings, long words and all documents."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import wordbpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text, piece=1 << 21):
    return np.frombuffer(b"".join(b"".join(x) for x in wordbpe.encoder(PATH).encode([text], piece)), "<u4").tolist()


def wanted(other, text):
    return other.encode(text, add_special_tokens=False).ids


def test_every_character(other):
    """Each assigned character alone between letters, so that its class, its lower case and its normal form all show."""
    own = wordbpe.encoder(PATH)
    points = [chr(c) for c in [*range(0xD800), *range(0xF900, 0x2FA20), *range(0x30000, 0x33500), *range(0xE0000, 0xE0200)]]
    different = []
    for a in range(0, len(points), 256):
        block = points[a:a + 256]
        if ids_of(" ".join(f"a{c}b" for c in block)) != wanted(other, " ".join(f"a{c}b" for c in block)):
            different += [c for c in block if ids_of(f"a{c}b") != wanted(other, f"a{c}b")]
    own.forget()
    assert not different, [hex(ord(c)) for c in different][:20]


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aabbc  \n.'S1=éß漢🙂ΣσİǺ<|startoftext|>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=200))
def test_same_ids_and_text(other, text):
    own = wordbpe.encoder(PATH)
    ids = wanted(other, text)
    assert ids_of(text) == ids == ids_of(text, piece=3)
    assert own.decode(np.array(ids, "<u4").tobytes()) == other.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>B <|startoftext|><|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "ΟΔΟΣ ΟΔΟΣ", "don't WE'LL i'm",
                                  "a" * 20_001, "ab" * 9_000, "aab" * 5_000 + " " * 7_777, "=" * 5_001, "漢字" * 3_000, "Ａ１ ①"])
def test_odd_texts(other, text):
    assert ids_of(text) == wanted(other, text) == ids_of(text, piece=2)


def test_long_random_word(other):
    rng = random.Random(1)
    text = "".join(rng.choices("etaoinshrdlu", k=60_000))
    assert ids_of(text) == wanted(other, text)


def test_all_documents(spark, other):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = wordbpe.digests(docs.select("doc_id", "text"), PATH).collect()
    assert len(got) == len(text)
    for r in got:
        ids = wanted(other, text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, other, monkeypatch):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (3, "Word wide " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = wordbpe.decode(wordbpe.encode(docs, PATH), PATH).collect()
    ids = wanted(other, rows[3][1])
    assert [len(r["ids"]) for r in back] == [0, 0, 0, len(ids)]
    assert [r["decoded"] for r in back] == ["", "", "", other.decode(ids)]
    digest = wordbpe.digests(docs, PATH).collect()
    assert digest[3]["decoded_sha256"] == hashlib.sha256(other.decode(ids).encode()).hexdigest() and digest[2]["n_tokens"] == 0
    assert wordbpe.digests(docs.limit(0), PATH).count() == 0
