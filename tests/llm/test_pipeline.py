"""The pipeline against brute-force versions of its stages, each on the rows that the stage before kept."""

import base64
import hashlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from ledgerlens.llm import jaccard, simhash
from tests.llm.test_decontam import plain
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_pii import PATTERN
from tests.llm.test_quality import judged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input rows and the rows after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [docs.collect()], tmp_path_factory.mktemp("steps")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        got.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_quality(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    trusted = [r for r in steps[0] if labels.get(r["doc_id"]) == 1]
    perplexity = judged([r["text"] for r in trusted])
    own_id = {r["doc_id"] for r in trusted}
    value = {r["doc_id"]: perplexity(r["text"], r["doc_id"] in own_id) for r in steps[0] if r["text"]}
    limit = {}
    for lang in {r["lang"] for r in trusted}:
        own = sorted(value[r["doc_id"]] for r in trusted if r["lang"] == lang and r["text"])
        limit[lang] = own[int(np.ceil(0.995 * len(own))) - 1] * 1.05
    for r in steps[0]:
        v, t = value.get(r["doc_id"]), limit.get(r["lang"])
        if v is not None and t is not None and abs(v / t - 1) > 0.0005:  # single-precision costs, rounded means
            assert (r["doc_id"] in ids(steps[1])) == (v <= t)


def test_near_duplicates(steps):
    wanted = plain_groups([(r["doc_id"], r["text"]) for r in steps[1]])
    assert ids(steps[2]) == wanted and len(steps[2]) == len(wanted)


def test_decontamination(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(steps[3]) == {d for d, _, hit, _ in plain([(r["doc_id"], r["text"]) for r in steps[2]], items) if not hit}


def test_personal_data(steps):
    after = {r["doc_id"]: r["text"] for r in steps[4]}
    assert after.keys() == ids(steps[3])
    for r in steps[3]:
        assert PATTERN.split(r["text"]) == PATTERN.split(after[r["doc_id"]])
        assert not set(PATTERN.findall(r["text"])) & set(PATTERN.findall(after[r["doc_id"]]))


def test_tokens_and_run(spark, steps):
    with open(corpus_pipeline.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in steps[4]}
    assert ids(steps[5]) == text.keys()
    for r in steps[5]:
        wanted = other.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(wanted), hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5]))


def test_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_through_fingerprints(spark, monkeypatch):
    """Groups of near fingerprints are verified: texts with other sets stay, copies that fingerprints miss go, and a crowd is not compared again."""
    chorus, words = "one two three four five six seven " * 300, [f"word{i}" for i in range(400)]
    edited = [*words[:200], *[f"other{i}" for i in range(50)], *words[200:]]
    texts = [chorus + " ".join(words[:14]), chorus + " ".join(words[20:34]), " ".join(words), " ".join(edited), None]
    a, b, c, d = (simhash.fingerprint_of(t) for t in texts[:4])
    assert (a ^ b).bit_count() <= simhash.RADIUS < (c ^ d).bit_count()
    crowd = "the crowd of copies each with one more word of its own ".split()
    texts += [" ".join([f"{w}{k}" for k in range(40) for w in crowd] + [f"own{i}"]) for i in range(60)]
    rows, counts, possible = list(enumerate(texts)), [], jaccard._possible
    assert plain_groups(rows) == {0, 1, 2, 4, 5}

    def counted(sets, pairs, threshold):
        counts.append(pairs.count())
        return possible(sets, pairs, threshold)

    monkeypatch.setattr(jaccard, "_possible", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(corpus_pipeline.one_of_each(spark, docs, SF).collect()) == {0, 1, 2, 4, 5}
    assert counts[0] >= 60 and sum(counts[1:]) < 60
