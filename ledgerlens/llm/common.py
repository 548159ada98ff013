"""Helpers that several operators share: batch sizes, stored tables, global ranks and connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialize

BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES, rows: int = 10_000) -> None:
    """Limits what one Arrow batch holds, so that a Python worker's memory does not depend on the length of the texts.

    A text longer than the limit still arrives whole, alone in its batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column on end, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def texts(column: pa.Array) -> list[str]:
    """The texts as Python strings; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").to_pylist()


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``limit`` bytes together, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def add_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with ``columns`` after its own; one of the same name is replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *columns.values()], [*kept, *columns])


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, lengthened until none of them is one of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Bits:
    """A set of 64-bit keys as a bit table of fixed size: it knows all its members and takes a few other keys for members."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        """Two places in the table for each key, one row per key."""
        h = keys.astype(np.uint64, copy=False)
        with np.errstate(over="ignore"):
            return np.stack([((h ^ (h >> np.uint64(31))) * m) >> np.uint64(64 - bits) for m in _MIX], 1).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, self.bits)
        return ((self.table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def bit_set(keys: DataFrame, bits: int = 25) -> Bits:
    """The bit table of the first column (longs) of ``keys``; ``2 ** bits`` bits whatever their number, put together on the executors word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            at = Bits.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).reshape(-1)
            np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(own)
        for a in range(0, len(word), 1 << 16):
            some = word[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], ["word", "ones"])

    found = keys.mapInArrow(run, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["ones"].to_numpy(np.int64).view(np.uint64)
    return Bits(table, bits)


def ranked(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds ``out``, the row's position from 0 in the order of ``order``, and stores the table.

    Rows are range partitioned and stored once; a row's position is its place in its own range plus the rows of the ranges
    before it. Rows that are equal in all of ``order`` are told apart by their place in the input, so that many repeated
    rows do not meet in one range.
    """
    spark = df.sparkSession
    keyed = df.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keyed = keyed.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    by = [*[F.col(f"_o{i}") for i in range(len(order))], F.col("_tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                         .withColumn("_n", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    # one number per range, at most spark.sql.shuffle.partitions of them
    sizes = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.lit(before), (part + 1).cast("int"))
    return stored.select(*[F.col(f"`{c}`") for c in df.columns], (start + place).alias(out))


def components(links: DataFrame, salt: int = 42) -> DataFrame:
    """Connected components of the graph with edges ``a``, ``b`` (longs): one row (``node``, ``root``) per linked node.

    Each round every node points to the neighbour (or itself) that comes first in an order drawn anew by hash; the graph is
    then contracted along these pointers. Every round removes a fixed share of the remaining nodes whatever the shape of
    the graph, so long chains need few rounds. Pointers are minima, combined before they are shuffled; joins meet stored
    tables on both sides, where Spark splits a hub's rows. Self-links give their node as its own root.
    """
    edges = materialize(links.select("a", "b").distinct(), "edges")
    steps = []
    while True:
        salt += 1

        def first(name: str, s: int = salt) -> Column:
            return F.struct(F.xxhash64(F.lit(s), F.col(name)).alias("h"), F.col(name).alias("v"))

        both = edges.select(F.col("a").alias("node"), first("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("node"), first("a").alias("to"))).unionByName(
            edges.select(F.col("a").alias("node"), first("a").alias("to"))).unionByName(
            edges.select(F.col("b").alias("node"), first("b").alias("to")))
        step = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.col("to.v").alias("to")), "step")
        steps.append(step)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        once = materialize(edges.join(left, "a").select(F.col("ra"), "b"), "half")
        both_ends = once.join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = materialize(both_ends.where("a != b").distinct(), "edges")
        if edges.isEmpty():
            break
    roots = steps.pop().toDF("node", "root")
    while steps:
        down = steps.pop()
        joined = down.join(roots.select(F.col("node").alias("to"), "root"), "to", "left")
        roots = materialize(joined.select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
