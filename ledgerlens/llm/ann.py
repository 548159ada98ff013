"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length one and projected onto a few random directions, anew for each of several curves, and shifted; the Hilbert
key of the projection orders them. Each order is a global rank over a range-partitioned table, cut into blocks of ``block_rows`` rows. A
query looks at the blocks around its own place, ``window`` of all rows to either side; blocks and queries meet by a shuffle on (curve, block), a
block keeps the ``k`` nearest of its rows per query, and these merge and rank again by the exact measure.

The window: neighbours in data without structure are hardly nearer than other rows, so their places on a curve differ by a share of the
table, whatever its size; the default finds 0.97 of the true neighbours of such vectors in 64 dimensions, and more if
there are clusters. Work then grows with queries times rows, as it does for a stated query set. For data with
structure set ``window_rows``, a fixed number of rows, and the work follows the rows. Recall is measured in the tests.

Equal vectors are one class that is searched once and listed by its members, so that a vector that a third of the rows share neither fills
a window nor a task; ties go to the smaller id.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part, nor do rows with a null id. Rows that repeat an id
and vector are one row; an id with several vectors is a row for each. Projections are scaled by the mean and spread of a sample of at most
about ``sample_rows`` vectors. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, ranked
from ledgerlens.session import materialize

BITS = 10


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers below ``2 ** bits``; columns times bits must be below 64.

    The transform first undoes the rotations and reflections of the sub-cubes from the coarsest bit on, then Gray-codes
    across the columns; the key takes the bits of all columns in turn.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            flip = (x[i] & high) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, np.uint64(0))
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    mask = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        mask ^= np.where((x[n - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= mask
    key = np.zeros(cells.shape[0], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return key.astype(np.int64)


class Curves:
    """Directions, scales and shifts of every curve."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(curves, sample.shape[1], dimensions))
        projected = _unit(sample) @ self.directions
        self.centre, self.spread = projected.mean(1), np.maximum(projected.std(1), 1e-12)
        self.shift = rng.random((curves, dimensions))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Keys of each vector on each curve."""
        unit = _unit(vectors)
        out = np.empty((len(unit), len(self.shift)), np.int64)
        for c, shift in enumerate(self.shift):
            z = (unit @ self.directions[c] - self.centre[c]) / self.spread[c]
            even = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # close to the normal distribution's share below
            out[:, c] = hilbert(((even + shift) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS)
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id``, ``v`` of the rows that take part."""
    big = float("inf")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
        & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest(vectors: DataFrame, is_query: Column | str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, curves: int = 8,
            dimensions: int = 4, window: float = 0.125, window_rows: int | None = None, block_rows: int = 2048, seed: int = 7,
            sample_rows: int = 10_000) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows of largest cosine for each row with ``is_query``, itself left out."""
    spark = vectors.sparkSession
    bounded_batches(spark, rows=4096)
    rows = usable(vectors, vec_id, embedding)
    asked = rows.join(vectors.where(is_query).select(F.col(vec_id).cast("long").alias("id")).distinct(), "id", "left_semi")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # classes of equal vectors, named by their smallest id
    flagged = rows.join(asked.select("id", F.lit(1).alias("q")).distinct(), "id", "left")
    classes = materialize(flagged.groupBy("v").agg(F.min("id").alias("class"), F.max("q").alias("q"), F.count("*").alias("n")), "classes")
    total = classes.count()
    if not total:
        return empty
    of_class = classes.select("class", "v").withColumnRenamed("v", "w")
    many = materialize(classes.where("n > 1").select("class", F.col("v").alias("w")), "many")
    first = Window.partitionBy("class").orderBy("id")
    members = (rows.join(many, F.col("v") == F.col("w")).select("class", "id").distinct().withColumn("r", F.row_number().over(first))
               .where(F.col("r") <= k + 1).select("class", "id"))
    members = materialize(members.unionByName(classes.where("n = 1").select("class", F.col("class").alias("id"))), "members")
    queries = materialize(asked.distinct().join(of_class, F.col("v") == F.col("w")).select("id", "class"), "queries")
    # keys, places and blocks
    rate = min(1.0, sample_rows / total)
    sample = classes.where(F.shiftrightunsigned(F.xxhash64(F.lit("ann"), "class"), 11) / float(1 << 53) < rate).select("v").toPandas()
    if not len(sample):
        sample = classes.select("v").limit(1).toPandas()
    model = spark.sparkContext.broadcast(Curves(np.array(sample["v"].tolist(), np.float64), curves, dimensions, seed))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.value.keys(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column("class").to_numpy(), curves)),
                    pa.array(np.tile(np.arange(curves), batch.num_rows)), pa.array(found.reshape(-1))], ["class", "curve", "key"])

    keyed = classes.select("class", "v").mapInArrow(keys, "class long, curve long, key long")
    placed = ranked(keyed, [F.col("curve"), F.col("key"), F.col("class")], "place")
    placed = placed.select("class", "curve", (F.col("place") - F.col("curve") * total).alias("place"))
    reach = window_rows if window_rows is not None else int(np.ceil(window * total))
    last = (total - 1) // block_rows
    data = placed.join(of_class, "class").select("curve", F.floor(F.col("place") / block_rows).alias("block"), "class", "w")
    around = F.sequence(F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / block_rows),
                        F.least(F.floor((F.col("place") + reach) / block_rows), F.lit(last)))
    searched = (placed.join(classes.where("q = 1").select("class", F.col("v").alias("w")), "class")
                .select("curve", F.explode(around).alias("block"), "class", "w"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("class").to_numpy(), right.column("class").to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            x, y = _matrix(left.column("w")), _matrix(right.column("w"))
            size = np.linalg.norm(y, axis=1)
            for i in range(0, len(a), 512):
                own, q = a[i:i + 512], x[i:i + 512]
                score = q @ y.T / (np.linalg.norm(q, axis=1)[:, None] * size)
                score[own[:, None] == b] = -np.inf
                order = np.lexsort((np.broadcast_to(b, score.shape), -score), axis=1)[:, :k] if score.shape[1] > k else (
                    np.broadcast_to(np.arange(len(b)), score.shape))
                best = np.take_along_axis(score, order, 1)
                keep = best > -np.inf
                found.append((np.repeat(own, order.shape[1]).reshape(order.shape)[keep], b[order][keep], best[keep]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("class", "other", "score"), zip(*found))})

    pairs = searched.toDF("curve", "block", "class", "w").groupBy("curve", "block").cogroup(data.groupBy("curve", "block")).applyInArrow(
        compare, "class long, other long, score double")
    best = Window.partitionBy("class").orderBy(F.desc("score"), "other")
    near = (pairs.groupBy("class", "other").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best))
            .where(F.col("r") <= k).select("class", "other", "score"))
    # a query's own class, then the members of the classes found; a class lists k + 1 members at most
    near = materialize(near, "near")
    one = F.aggregate("w", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    itself = classes.where("q = 1 AND n > 1").select("class", F.col("class").alias("other"), F.col("v").alias("w")).select(
        "class", "other", (one / (F.sqrt(one) * F.sqrt(one))).alias("score"))
    listed = near.unionByName(itself).join(members.toDF("other", "vec_id"), "other").select("class", "vec_id", "score")
    # the k + 1 first of a class hold the k first of each of its queries
    front = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    listed = materialize(listed.withColumn("r", F.row_number().over(front)).where(F.col("r") <= k + 1).drop("r"), "listed")
    joined = queries.join(listed, "class").where("id != vec_id")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return (joined.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
