"""Unsupervised scores: robust z and an isolation forest. Labels are never read here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import wide_quantiles

# Features of the robust z-score and whether they are log-transformed.
ROBUST_Z_FEATURES = {"amount_logz": False, "cnt_1h": True, "cnt_24h_vs_daily_rate": True, "dist_from_home_km": True,
                     "implied_speed_kmh": True, "small_cnt_30m": True, "amount_to_merch_mean": True}

# Features of the isolation forest.
FOREST_FEATURES = ["log_amount", "cnt_1h", "cnt_24h", "amount_logz", "amount_to_mean", "dist_from_home_km",
                   "implied_speed_kmh", "hour_local", "is_online", "new_device", "new_merchant_for_cust",
                   "merch_fraud_rate_matured", "small_cnt_30m", "distinct_merchants_24h"]


# ---------------------------------------------------------------------------------------------- robust z
def _transformed(feature: str) -> Column:
    x = F.col(feature).cast("double")
    return F.log1p(x) if ROBUST_Z_FEATURES[feature] else x


def fit_robust_z(features: DataFrame) -> DataFrame:
    """One row per feature: ``feature, center, scale`` (median and 1.4826 * median absolute deviation).

    Nearly constant features fall back to the mean absolute deviation, then to the standard deviation.
    """
    x = {f: _transformed(f) for f in ROBUST_Z_FEATURES}
    center = {r["feature"]: r["q"] for r in wide_quantiles(features, x, [0.5]).collect()}  # seven numbers
    away = {f: F.abs(x[f] - c) for f, c in center.items()}
    mad = {r["feature"]: r["q"] for r in wide_quantiles(features, away, [0.5]).collect()}
    spread = features.agg(*[a for f in center for a in (F.avg(away[f]).alias(f"d_{f}"), F.stddev_samp(x[f]).alias(f"s_{f}"))]).first()

    def scale(f: str) -> float:
        return 1.4826 * mad[f] if mad[f] >= 1e-9 else max(spread[f"d_{f}"] / 1.2533, spread[f"s_{f}"] or 0.0, 1e-3)

    return features.sparkSession.createDataFrame([(f, c, scale(f)) for f, c in center.items()],
                                                 "feature string, center double, scale double")


def robust_z_params(fitted: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted table (seven rows) as numbers."""
    return {r["feature"]: (r["center"], r["scale"]) for r in fitted.collect()}


def robust_z_score(params: dict[str, tuple[float, float]]) -> Column:
    """Mean of the two largest positive z values; missing features count as 0."""
    zs = []
    for feature, (center, scale) in params.items():
        z = F.when(_transformed(feature).isNotNull(),
                   F.greatest(F.lit(-50.0), F.least((_transformed(feature) - center) / scale, F.lit(50.0))))
        zs.append(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(0.0)))
    top = F.slice(F.sort_array(F.array(*zs), asc=False), 1, 2)
    return (top[0] + top[1]) / 2


# -------------------------------------------------------------------------------------- isolation forest
@dataclass(frozen=True)
class IsolationForest:
    """Split nodes of all trees as flat arrays (at most trees * 2 * sample entries) and the per-tree roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length); near 1 = anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(go_left, self.left[node], self.right[node]), node)
            total += self.depth[node]
        return np.power(2.0, -total / len(self.roots) / max(_expected_path(self.sample), 1e-9))


def _expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


NODE_SCHEMA = "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, depth DOUBLE"


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random axis-parallel splits of one sample down to single points or the depth limit."""
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, level, parent, is_right = stack.pop()
        me = len(nodes)
        if parent >= 0:
            f, t, left, right, d = nodes[parent]
            nodes[parent] = (f, t, left, me, d) if is_right else (f, t, me, right, d)
        part = x[rows]
        varying = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else np.array([], int)
        if level >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((-1, 0.0, -1, -1, level + _expected_path(len(rows))))
            continue
        f = int(rng.choice(varying))
        low, high = part[:, f].min(), part[:, f].max()
        t = float(rng.uniform(low, high))
        nodes.append((f, t, -1, -1, 0.0))
        below = part[:, f] <= t
        stack.append((rows[~below], level + 1, me, True))
        stack.append((rows[below], level + 1, me, False))
    return nodes


def fit_forest(features: DataFrame, seed: int, trees: int = 200, sample: int = 256) -> IsolationForest:
    """Trees grow in parallel, each on its own hash-chosen sample of ``sample`` of all rows.

    A row draws as many tickets as it is expected to be chosen, rounded up; a ticket wins by a hash and names a tree by another.
    In a large table that is one ticket, so the work per row does not depend on the number of trees.
    """
    total = features.count()
    rows = features.select("txn_id", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0))
                                               for f in FOREST_FEATURES]).alias("x"))
    size = min(sample, total)

    def share(*key):
        """Uniform number in [0, 1) from a seeded hash."""
        return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / float(1 << 40))

    keep = min(1.0, (1.3 * size + 8.0) / max(total, 1))  # share of the rows that a tree draws from
    if keep < 0.1:
        tickets = max(1, int(np.ceil(trees * keep)))
        won = F.filter(F.sequence(F.lit(0), F.lit(tickets - 1)), lambda k: share(F.col("txn_id"), k) < trees * keep / tickets)
        own = F.array_distinct(F.transform(won, lambda k: F.pmod(F.xxhash64(F.lit(seed + 1), "txn_id", k), F.lit(trees)).cast("int")))
    else:  # a table of a few samples: nearly every row belongs to many trees
        own = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: share(F.col("txn_id"), t) < keep)
    chosen = rows.withColumn("tree", F.explode(own))
    chosen = chosen.withColumn("pick", share(F.col("txn_id"), F.col("tree")))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values(["pick", "txn_id"]).head(size)
        nodes = _grow(np.array(pdf["x"].tolist(), dtype=float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    nodes = (chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
             .sort_values(["tree", "node"]).reset_index(drop=True))
    start = nodes.groupby("tree").node.transform("size").groupby(nodes.tree).first().cumsum().shift(fill_value=0)
    base = nodes.tree.map(start).to_numpy()
    left, right = nodes.left.to_numpy(), nodes.right.to_numpy()
    return IsolationForest(nodes.feature.to_numpy(), nodes.threshold.to_numpy(),
                           np.where(left >= 0, left + base, -1), np.where(right >= 0, right + base, -1),
                           nodes.depth.to_numpy(), start.to_numpy(), size)


def forest_score(forest: IsolationForest, features: DataFrame) -> Column:
    """Column with the anomaly score, evaluated in Arrow batches with the forest shipped once per executor."""
    shipped = features.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(shipped.value.score(np.stack(xs.to_numpy())) if len(xs) else [], dtype=float)

    return score(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in FOREST_FEATURES]))
