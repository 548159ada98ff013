"""Ranked lexical search with range maxima over posting lists.

Weights: a term's occurrences in a document are weighed by rarity, saturation and length in whole numbers, as ``weight`` and ``impacts`` state; a document's
score is the sum over the item's terms, repeats included.

Index: documents are read once; every block of them that a task reads is a shard and becomes one row: ids and lengths of its documents and, for each term that
an item uses, the posting list of its documents with the number of occurrences. Counts for the weights (documents with terms, all terms, documents per
term) are sums over the shards. Documents are not shuffled.

Search: the posting lists of a shard lie on end under one sparse table of range maxima, so the greatest impact of a term between any two documents is
read off in two look-ups. For each item the interval of all documents goes into a queue ordered by its bound, the sum of the range maxima of the item's
terms. The interval with the highest bound is taken out; it is split at the document where the term of the largest share has its maximum; that document is
scored, and the intervals on either side go back with their own bounds. Intervals of at most ``leaf`` documents are scored
whole. The search of an item ends when no bound reaches the k-th best score, which a task carries on from shard to shard. Nothing that could belong to the
result is skipped, so it is exact; equal scores are kept apart by id.

Items come in parts of at most ``part_bytes`` bytes of text, each broadcast by itself, so a broadcast has that bound however many items
there are; the index is built part by part. A task hands on ``k`` rows per item, and these are cut to ``k`` per group of tasks before they meet.

Every row of ``items`` is an item of its own, repeated ids and null ids too; null texts and texts without terms have no result. Repeated documents are ranked each; documents with a null
id come after the others of equal score. Null and empty documents have no terms and count for nothing. An empty table on either side gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import Lookup, words
from ledgerlens.llm.common import bounded_batches, pieces, utf8
from ledgerlens.session import materialize

K = 10
LEAF = 64
SHARD_BYTES = 4 << 20
LONGEST = np.iinfo(np.int64).max


class Items(NamedTuple):
    """Terms of the items of one part: the different term numbers of each with how often it has them, and their hashes in order."""

    lookup: Lookup
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    number: np.ndarray  # of each item, in the whole table


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    w = words(data, offsets)
    lookup = Lookup(w.hash)
    at = lookup(w.hash)
    cuts = np.searchsorted(w.text, np.arange(len(rows) + 1))
    found = [np.unique(at[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:])]
    return Items(lookup, [t for t, _ in found], [n for _, n in found], np.array([i for i, _ in rows], np.int64))


def weight(documents: int, holding: int) -> int:
    """Rarity of a term that ``holding`` of ``documents`` have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each posting adds to a score; ``size`` is the number of terms of its document, ``total`` that of all ``documents``."""
    if len(size) and 75 * int(size.max()) * documents > LONGEST:
        size = size.astype(object)
    m = (25 + 75 * size * documents // max(total, 1)).astype(np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def index(documents: DataFrame, items: Items, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ``ids`` and ``sizes`` of its documents that have terms; ``terms``, ``lengths`` of the posting lists that are not empty; ``docs``, ``tfs``, these lists on end."""
    bounded_batches(documents.sparkSession, SHARD_BYTES)
    shared = documents.sparkSession.sparkContext.broadcast(items.lookup)
    number, kind = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, SHARD_BYTES):
                w = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                size = np.bincount(w.text, minlength=b - a)
                term = shared.value(w.hash)
                hit = term >= 0
                key, tf = np.unique(term[hit] * (b - a) + w.text[hit], return_counts=True)
                filled = np.flatnonzero(size)
                place = np.cumsum(size > 0) - 1  # documents without terms are left out
                names, length = np.unique(key // max(b - a, 1), return_counts=True)
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64()).take(pa.array(filled))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([size[filled]], kind), pa.array([names.astype(np.int32)], number), pa.array([length.astype(np.int32)], number),
                    pa.array([place[key % max(b - a, 1)].astype(np.int32)], number), pa.array([tf.astype(np.int32)], number)],
                    ["ids", "sizes", "terms", "lengths", "docs", "tfs"])

    own = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, docs array<int>, tfs array<int>")


class Shard:
    """Posting lists on end, under a sparse table of range maxima of their impacts."""

    def __init__(self, terms: np.ndarray, lengths: np.ndarray, docs: np.ndarray, impact: np.ndarray, documents: int):
        self.documents, self.docs = documents, docs
        self.begin = np.cumsum(lengths) - lengths
        self.end = self.begin + lengths
        self.place = {t: i for i, t in enumerate(terms.tolist())}
        self.table = [impact]
        width = 1
        while 2 * width <= int(lengths.max(initial=0)):
            last = self.table[-1]
            self.table.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def highest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Greatest impact among the postings [begin, end) of each list, zero for an empty range."""
        size = end - begin
        level = np.frexp(np.maximum(size, 1))[1] - 1
        out = np.zeros(len(begin), np.int64)
        for k in np.unique(level[size > 0]).tolist():
            at = np.flatnonzero((level == k) & (size > 0))
            row = self.table[k]
            out[at] = np.maximum(row[begin[at]], row[end[at] - (1 << k)])
        return out

    def search(self, terms: np.ndarray, repeats: np.ndarray, ids: list, best: list[tuple], k: int, leaf: int) -> list[tuple]:
        """``best`` (score, order of the id, id) of an item, ascending, with the documents of this shard that belong to it."""
        own = [(self.place[t], n) for t, n in zip(terms.tolist(), repeats.tolist()) if t in self.place]
        if not own:
            return best
        lists, times = np.array([x for x, _ in own]), np.array([n for _, n in own], np.int64)
        impact, docs = self.table[0], self.docs

        def bounded(first: int, last: int, begin: np.ndarray, end: np.ndarray) -> None:
            parts = self.highest(begin, end) * times
            bound = int(parts.sum())
            if bound > 0:
                heappush(queue, (-bound, first, last, begin, end, int(parts.argmax())))

        def offer(doc: int, score: int) -> None:
            entry = (-score, ids[doc] is None, ids[doc] or 0)
            if score > 0 and (len(best) < k or entry < best[-1]):
                at = len(best)
                while at and best[at - 1] > entry:
                    at -= 1
                best.insert(at, entry)
                del best[k:]

        queue: list = []
        bounded(0, self.documents, self.begin[lists], self.end[lists])
        while queue:
            bound, first, last, begin, end, most = heappop(queue)
            if len(best) == k and bound > best[-1][0]:
                break  # also no document of equal score and smaller id
            if last - first <= leaf:
                size = end - begin
                at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                total = np.zeros(last - first, np.int64)
                np.add.at(total, docs[at] - first, impact[at] * np.repeat(times, size))
                limit = -best[-1][0] if len(best) == k else 1
                for doc in np.flatnonzero(total >= limit).tolist():
                    offer(first + doc, int(total[doc]))
                continue
            split = int(docs[begin[most] + int(impact[begin[most]:end[most]].argmax())])
            middle = np.array([b + np.searchsorted(docs[b:e], split) for b, e in zip(begin, end)])
            after = middle + ((middle < end) & (docs[np.minimum(middle, len(docs) - 1)] == split))
            here = after > middle
            offer(split, int((impact[middle[here]] * times[here]).sum()))
            bounded(first, split, begin, middle)
            bounded(split + 1, last, after, end)
        return best


def search(shards: DataFrame, items: Items, k: int = K, leaf: int = LEAF) -> DataFrame:
    """``number`` (of the item), ``doc_id``, ``score``: the ``k`` best documents of the shards of each task."""
    spark = shards.sparkSession
    counts = shards.agg(F.sum(F.size("ids").cast("long")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("l")).head()
    documents, total = counts["n"] or 0, counts["l"] or 0
    # one number per term of this part of the items, whose text has a bounded size
    holding = (shards.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy("x.terms").agg(F.sum("x.lengths").alias("n")).toPandas())
    weights = np.zeros(len(items.lookup.keys), np.int64)
    weights[holding["terms"].to_numpy(np.int64)] = [weight(documents, int(n)) for n in holding["n"]]
    shared = spark.sparkContext.broadcast((items.terms, items.repeats, items.number, weights))
    # a shard has up to a few megabytes of postings
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, repeats, number, weights = shared.value
        best: list[list[tuple]] = [[] for _ in terms]
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, names, lengths, docs, tfs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                                                    for c in ("sizes", "terms", "lengths", "docs", "tfs"))
                impact = impacts(np.repeat(weights[names], lengths), tfs, sizes[docs], documents, total)
                shard, ids = Shard(names, lengths, docs, impact, len(sizes)), batch.column("ids")[i].as_py()
                for j, own in enumerate(terms):
                    best[j] = shard.search(own, repeats[j], ids, best[j], k, leaf)
        rows = [(int(number[j]), None if none else d, -s) for j, own in enumerate(best) for s, none, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["number", "doc_id", "score"])

    return shards.mapInArrow(run, "number long, doc_id long, score long")


def rank(documents: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
         part_bytes: int = 8 << 20, leaf: int = LEAF) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents of highest score above zero for each item."""
    spark = documents.sparkSession
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")), "items")
    size = numbered.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    parts = -(-size // part_bytes) or 1
    found = None
    for p in range(parts):
        own = read_items([tuple(r) for r in numbered.where((F.xxhash64("number") % parts + parts) % parts == p).select("number", "t").collect()])
        shards = materialize(index(documents, own, doc_id, text), "shards")
        some = search(shards, own, k, leaf)
        found = some if found is None else found.unionByName(some)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    group = F.spark_partition_id() % 64
    first = Window.partitionBy("number", "g").orderBy(*order)
    fewer = found.withColumn("g", group).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    best = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(numbered.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
