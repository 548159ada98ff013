"""Quality classifier: the model against its definition, held-apart classes of text, odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import quality
from ledgerlens.llm.common import utf8

SF = "/root/testdata/sf0.01"


def coded(text):
    return [0] * (quality.ORDER - 1) + list((text or "").encode())


def fold_of(text):
    return 1 + xxhash.xxh64((text or "").encode(), seed=42).intdigest() % quality.FOLDS


def judged(trusted):
    """Function (text, is trusted) -> perplexity; trusted texts are judged without their fold."""
    models = [Plain([t for t in trusted if fold_of(t) != m]) for m in range(quality.FOLDS + 1)]
    return lambda text, own: math.exp(round(math.log(models[fold_of(text) if own else 0].perplexity(text)), 4))


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, many):
        n = quality.ORDER
        top = Counter(tuple(c[i:i + n]) for c in map(coded, many) for i in range(len(c) - n + 1))
        self.counts = {n: top}
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.freed = {}, {}, {}
        for k, table in self.counts.items():
            m = Counter(c for c in table.values() if c <= 4)
            if m[1] and m[2] and m[3]:
                y = m[1] / (m[1] + 2 * m[2])
                raw = [1 - 2 * y * m[2] / m[1], 2 - 3 * y * m[3] / m[2], 3 - 4 * y * m[4] / m[3]]
                self.d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
            else:
                self.d[k] = [0.5, 0.75, 0.9]
            self.total[k], self.freed[k] = defaultdict(int), defaultdict(float)
            for g, c in table.items():
                self.total[k][g[:-1]] += c
                self.freed[k][g[:-1]] += self.d[k][min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / quality.SYMBOLS
        total = self.total[k].get(g[:-1], 0)
        if not total:
            return self.p(g[1:])
        c = self.counts[k].get(g, 0)
        own = (c - self.d[k][min(c, 3) - 1]) / total if c else 0
        return own + self.freed[k][g[:-1]] / total * self.p(g[1:])

    def perplexity(self, text):
        c = coded(text)
        n = quality.ORDER
        logs = [math.log(self.p(tuple(c[i:i + n]))) for i in range(len(c) - n + 1)]
        return math.exp(-sum(logs) / len(logs))


def found(spark, rows, trusted):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")
    return {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}


def test_model(spark, monkeypatch):
    """Perplexities, thresholds and decisions against the definition; blocks of a few rows, so that texts of a partition lie in many."""
    monkeypatch.setattr(quality, "BLOCK", 700)
    rng = np.random.default_rng(8)
    many = ["".join(rng.choice(list("aabcdE.é "), rng.integers(1, 120))) for _ in range(80)] + [None, ""]
    many += many[:5] + ["zzz", "a", "E!" * 300, "bé caab" * 50]
    rows = [(i, t, "xyz"[i % 3] if i % 7 else None) for i, t in enumerate(many)]
    trusted = [i for i, t, lang in rows if i % 2 == 0 and i < 82 and lang != "z"]
    got = found(spark, rows, trusted)
    value = judged([many[i] for i in trusted])
    wanted = {i: value(t, i in trusted) for i, t, _ in rows if t}
    for i, t, lang in rows:
        assert (got[i]["perplexity"] is None) == (not t)
        if t:
            assert np.isclose(got[i]["perplexity"], wanted[i], rtol=2.1e-4)
        own = sorted(got[j]["perplexity"] for j in trusted if rows[j][1] and (lang not in ("x", "y") or rows[j][2] == lang))
        limit = own[math.ceil(quality.QUANTILE * len(own)) - 1] * quality.MARGIN
        assert np.isclose(got[i]["threshold"], limit, rtol=1e-12)
        assert got[i]["keep"] == (not t or got[i]["perplexity"] <= got[i]["threshold"])


def test_probabilities_add_up(spark):
    """After any context the probabilities of all bytes sum to one, in every model."""
    texts = spark.createDataFrame([(t, 1 + i % 2, 0) for i, t in enumerate(["the cat sat", "a cat ran", "the dog sat", "bat"])],
                                  "text string, model int, part int").coalesce(1)
    needs = quality.asked(texts, "text", "model", "part")
    ends = [(0, b"the c"), (1, b"the c"), (2, b"\0\0\0\0\0"), (0, b"zzzzz"), (1, b"ncat ")]
    ends = [(m, h[1 - quality.ORDER:]) for m, h in ends]
    wanted = spark.createDataFrame([((m << quality.MODEL) | int.from_bytes(h + bytes([b]), "big"),) for m, h in ends for b in range(256)], "gram long")
    p = quality.probabilities(wanted, quality.counts(needs)).groupBy(F.shiftright("gram", 8)).agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    assert all(r["n"] == 256 and abs(r["p"] - 1) < 1e-9 for r in p.collect())


def test_shuffled_words_and_keyword_lists(spark):
    """Real words in the wrong order or without grammar are rejected; fresh sentences of the trusted kind stay."""
    rng = np.random.default_rng(5)
    one = [["the", "a", "our"], ["old", "small", "grey", "quiet"], ["farmer", "doctor", "painter", "sailor"], ["often", "rarely", "never"],
           ["visits", "paints", "crosses"], ["the", "that"], ["village", "harbour", "river", "market"], ["before", "after"], ["sunrise.", "dinner.", "winter."]]
    text = lambda: " ".join(str(rng.choice(w)) for _ in range(12) for w in one)
    rows = [(i, text(), "en") for i in range(260)]
    mixed = [(300 + i, " ".join(rng.permutation(text().split()).tolist()), "en") for i in range(20)]
    lists = [(400 + i, ", ".join(rng.choice(one[2] + one[6], 80).tolist()), "en") for i in range(20)]
    got = found(spark, rows + mixed + lists, range(200))
    assert all(got[i]["keep"] for i in range(200, 260)) and sum(got[i]["keep"] for i in range(200)) >= 198
    assert not any(got[r[0]]["keep"] for r in mixed + lists)


def test_grams_do_not_cross_texts():
    data, offsets = utf8(pa.array(["ab", "", "c", None, "abcdefgh"]))
    n = quality.ORDER
    wanted = [int.from_bytes(bytes(c[i:i + n]), "big") for c in map(coded, ["ab", "c", "abcdefgh"]) for i in range(len(c) - n + 1)]
    assert quality.grams(data, offsets).tolist() == wanted


def test_keeps_good_and_rejects_bad(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_odd_rows(spark):
    good = [(i, f"the cat sat on the mat number {i} and slept there. " * 3, "en") for i in range(40)]
    rows = good + [(100, None, "en"), (101, "", None), (None, "the cat sat on the mat number 7 and slept", None), (102, "#$%#$%#$%" * 20, "xx"),
                   (103, "the cat sat on the mat number 7 and slept there. " * 100_000, "en"), (103, "%%%!!!" * 9, "en")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, threshold string")
    lab = spark.createDataFrame([(i, 1) for i in range(40)] + [(0, 1), (None, 1), (102, None), (103, 0)], "doc_id long, quality int")
    got = {(r["doc_id"], (r["text"] or "")[:3]): r for r in quality.judge(d, lab).collect()}
    assert len(got) == len(rows)
    assert not got[102, "#$%"]["keep"] and not got[103, "%%%"]["keep"] and got[103, "the"]["keep"] and got[None, "the"]["keep"]
    assert got[100, ""]["keep"] and got[100, ""]["perplexity"] is None and got[101, ""]["keep"]
    assert all(r["keep"] for r in quality.judge(d, lab.limit(0)).collect())
    assert quality.judge(d.limit(0), lab).count() == 0


def test_repeatable_and_many_trusted_ids(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    few = quality.judge(docs, labels, stored=True).select("doc_id", "perplexity", "threshold", "keep").collect()
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    many = quality.judge(docs.repartition(5), labels).select("doc_id", "perplexity", "threshold", "keep").collect()
    assert sorted(few) == sorted(many)


def test_clashing_columns(spark):
    names = ["model", "part", "mean", "key", "value", "trusted", "block", "kind", "gram", "cost", "lang_", "limit", "_lang", "_limit", "h", "n"]
    rows = [(i, f"the cat sat on mat {i}", "en", *range(len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    got = quality.judge(docs, labels)
    assert got.columns == [*docs.columns, "perplexity", "threshold", "keep"]
    assert sorted(tuple(r)[:len(docs.columns)] for r in got.collect()) == rows
