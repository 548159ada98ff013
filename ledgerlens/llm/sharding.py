"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within their source; a row's fraction is its rank in the source over the size of the source. Sorting all
rows by fraction interleaves the sources in proportion, so every stretch of the order has the mixture of the whole, and cutting
the order into stretches of equal row counts gives shards that match it. Row counts of shards differ by one at most (law
``rows``), a source's share of a shard by about one row.

Both orders are global ranks over range-partitioned tables (``common.ranked``): no source, however large, is gathered in one
task, and texts are not moved, only ids, sizes and checksums.

A null source is a source of its own, a null text has no bytes, repeated rows are told apart by their place, an empty table gives
no rows. The random order is md5 of seed and id; rows with equal ids follow in the order of their checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ranked
from ledgerlens.session import materialize

EXTRA = 8


def shuffle_key(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def interleave(documents: DataFrame, shards: int, seed: int = 42, doc_id: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``text_crc32``, ``position`` in the interleaved order, ``shard`` and ``slot`` of each row."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                            (F.octet_length(data) + EXTRA).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    key = shuffle_key(seed, F.col("doc_id"))
    within = ranked(rows, [F.col("source"), key, F.col("doc_id"), F.col("text_crc32")], "_place")
    # sources stand on end in this order: a source's first place turns a place into a rank
    sources = materialize(within.groupBy(F.col("source").alias("_source")).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows")), "sources")
    joined = within.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    fraction = (F.col("_place") - F.col("_first") + 0.5) / F.col("_rows")
    mixed = ranked(joined.select(*rows.columns, fraction.alias("_fraction")),
                   [F.col("_fraction"), key, F.col("source"), F.col("text_crc32")], "position")
    total = mixed.count()
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (mixed.withColumn("shard", shard.cast("int"))
            .select(*rows.columns, "position", "shard", (F.col("position") - first).cast("long").alias("slot")))
