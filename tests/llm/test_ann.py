"""Nearest neighbours: the curve, recall against brute force, classes of equal vectors, odd rows."""

import numpy as np

from ledgerlens.llm import ann

SF = "/root/testdata/sf0.01"
FIVE = "vec_id % 50 = 0"


def exact(ids, x, query, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u[query]
    order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[query]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hilbert_visits_every_cell_by_single_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n)
        key = ann.hilbert(cells, bits)
        assert sorted(key) == list(range(side**n))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    got = by_query(ann.nearest(df, FIVE, block_rows=32))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        wanted = dict(exact(ids, x, int(np.flatnonzero(ids == q)[0])))
        score = dict(exact(ids, x, int(np.flatnonzero(ids == q)[0]), len(ids)))
        assert all(abs(score[v] - s) < 1e-12 for v, s in found) and len(found) == 5
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hit += len(wanted.keys() & dict(found).keys())
    assert hit / (5 * len(got)) >= 0.9


def test_full_window_is_exact_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[::3] = x[0]  # a third are equal
    x[5] = 2 * x[4]
    rows = [(i, [float(v) for v in x[i]], "a") for i in range(300)]
    rows += [(400, None, "a"), (450, [0.0] * 8, "a"), (500, [float("nan")] * 8, "a"), (550, [1.0, None] * 4, "a"), (600, [1.0], "a"),
             (650, [float("inf")] * 8, "a"), (None, [1.0] * 8, "a"), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = by_query(ann.nearest(df, FIVE, window=1.0, block_rows=16))
    assert set(got) == set(range(0, 300, 50))
    for q, found in got.items():
        wanted = exact(np.arange(300), x.astype(float), q)
        assert [v for v, _ in found] == [v for v, _ in wanted]
        assert np.allclose([s for _, s in found], [s for _, s in wanted], atol=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [v for v, _ in by_query(ann.nearest(df, FIVE))[0]] == [1, 2]
    assert ann.nearest(df.where("vec_id = 0"), FIVE).count() == 0
    assert ann.nearest(df.limit(0), FIVE).count() == 0
