"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, most=5, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                counts.update((lang, *w[i:i + n]) for i in range(len(w) - n + 1))
    candidates = {g: f for g, f in counts.items() if len(g) > 2 and f >= least}
    gone = set()
    for g, f in candidates.items():
        for n in range(2, len(g) - 1):
            for i in range(1, len(g) - n + 1):
                part = (g[0], *g[i:i + n])
                if f >= candidates[part]:
                    gone.add(part)
    out = []
    for lang in total:
        rows = []
        for g, a in candidates.items():
            if g[0] == lang and g not in gone:
                s, _, l, r = min((1000 * a * total[lang] // (counts[g[:k]] * counts[(lang, *g[k:])]), k, counts[g[:k]], counts[(lang, *g[k:])])
                                 for k in range(2, len(g)))
                rows.append((-s, -a, " ".join(g[1:]).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = plain([tuple(r) for r in docs.select("text", "lang").collect()], 100)
    assert got(collocations.collocations(docs)) == wanted and len(wanted) > 50


@pytest.mark.parametrize("ranges", ["1", "13"])
def test_few_words(spark, ranges):
    """So few words that the extensions of one phrase fill several ranges; passages that repeat, so that parts are left out."""
    rng = random.Random(4)
    fixed = [" ".join(rng.choices("uvwxyz", k=6)) for _ in range(3)]
    docs = []
    for _ in range(150):
        body = [rng.choice("aaaabbcde") + rng.choice(["", "", "", ",", "\t", ".", "!"]) for _ in range(rng.randrange(0, 60))]
        body.insert(rng.randrange(len(body) + 1), rng.choice(fixed))
        docs.append((" ".join(body), rng.choice(["en", "en", None, "und", "x"])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.createDataFrame(docs, "text string, lang string")
        for least, top in ((3, 2000), (10, 5)):
            assert got(collocations.collocations(df, least=least, top=top, bits=10)) == plain(docs, least, top=top)
        assert got(collocations.collocations(df, least=5, most=3)) == plain(docs, 5, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    odd = "Ä\x01b \x1fc  a\x00b\x0bA B. é é é é, Ab ab"
    docs = [(odd, "en")] * 7 + [(None, "en"), ("", None), ("...", "en"), ("Wide word " * 200_000 + ". " + "x" * 300_000, None), ("no break " * 700_000, "l")]
    df = spark.createDataFrame([(*d, 1, "q", 2) for d in docs], "text string, lang string, f int, p string, n int")
    assert got(collocations.collocations(df, least=5)) == plain(docs, 5)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("text = ''")).count() == 0


def test_exact_products():
    """Scores beyond 64 bits on the way."""
    a, n = 3_000_000_000_000_000, 9_000_000_000_000_000
    rows = [("en", (1,), a, 0, None), ("en", (1, 2), a, 0, None), ("en", (1, 2, 3), a - 1, 0, None), ("fr", (1, 9, 9), 4, 0, None)]
    out = {x[:2]: x for x in collocations.lockstep(iter(rows))}
    assert out["en", (1, 2)][2:5] == (a, a - 1, [a]) and out["en", (1, 2, 3)][4] == [a, a]
    assert out["fr", (1, 9, 9)][4] == [None, None] and out["fr", (1, 9)][2:4] == (None, 4)
    assert 1000 * a * n // (a * a) == 3000
