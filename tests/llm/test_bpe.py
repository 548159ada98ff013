"""BPE against another implementation of the same merges, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import bpe

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text, piece=1 << 21):
    own = bpe.encoder(PATH, PATTERN)
    return np.frombuffer(b"".join(b"".join(x) for x in own.encode([text], piece)), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aabbc  \n.'=1éß漢🙂"), st.characters(exclude_categories=["Cs"])), max_size=200))
def test_same_ids(other, text):
    own = bpe.encoder(PATH, PATTERN)
    wanted = other.encode_ordinary(text)
    assert ids_of(text) == wanted
    assert [i for w in own.pattern.findall(text) for i in own.encode_one(w.encode())] == wanted
    assert ids_of(text, piece=3) == wanted
    assert own.decode(np.array(wanted, "<u4").tobytes()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 7_777, "=" * 5_001, "漢字" * 3_000, "x1" * 4_000])
def test_long_pre_tokens(other, text):
    assert ids_of(text) == other.encode_ordinary(text)


def test_queue_order():
    queue = bpe.RankQueue(50_256)
    for r in (50_255, 4096, 63, 64, 0, 4095):
        queue.push(r, r)
    out = []
    while (r := queue.lowest()) >= 0:
        out += queue.take(r)
    assert out == [0, 63, 64, 4095, 4096, 50_255]


def test_all_documents(spark, other):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.digests(docs, PATH, PATTERN).collect():
        wanted = other.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(wanted)
        assert r["ids_sha256"] == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, other):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (3, "word " * 500_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH, PATTERN)
    back = bpe.decode(coded, PATH, PATTERN).collect()
    assert [len(r["ids"]) for r in back] == [0, 0, 0, len(other.encode_ordinary(rows[3][1]))]
    assert [bytes(r["decoded"]) for r in back] == [b"", b"", b"", rows[3][1].encode()]
    assert bpe.digests(docs, PATH, PATTERN).select("n_tokens").collect()[2][0] == 0
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0
