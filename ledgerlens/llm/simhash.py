"""SimHash near-duplicate groups.

Fingerprints: texts are lower-cased in A-Z and cut at ASCII white space; a shingle is four words joined by a space (all words if
there are fewer), hashed by XXH64 with seed 42, repeats included; a bit of the fingerprint is set if more than half of the hashes have it.
A text without words, null included, has fingerprint zero and links like any other.

Links: fingerprints with at most ``radius`` differing bits. Their 64 bits are cut into ``blocks`` blocks; two linked
fingerprints agree in at least ``blocks - radius`` of them, so every link is inside a group that shares one choice of that many
blocks. Groups are compared bit-sliced: 64 neighbouring rows become 64 words, one per bit plane; a row is compared with all 64
at once by adding the differing planes into carry-save counters of three bits and an overflow mark, and (row, lane block)
pairs in which every lane has passed the radius are left early. What leaves a group is one link per fingerprint to the smallest
of those it is connected with there, never all pairs, so a group of many near copies gives no more links than it has rows.

Equal fingerprints are one node. A group that very many fingerprints share is cut again: the bits outside its chosen blocks are
cut into ``radius + 1`` pieces, of which two linked rows must agree in one, so each row joins one smaller group per piece and no
link is lost. Components are found by contraction in Spark; nothing about documents is gathered on the driver.

Repeated rows form one group; rows with a null id take part and are never a group's smallest unless all are null. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import add_columns, bounded_batches, components, texts
from ledgerlens.session import materialize

RADIUS = 4
SHINGLE = 4
SEED = 42


_SPACE = re.compile(rb"[ \t-\r]")


def _digests(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    joined = b" ".join(words)
    bounds = np.cumsum([len(w) + 1 for w in words])
    first = [0, *bounds[:len(words) - size].tolist()]
    last = (bounds[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def _shingle_hashes(text: bytes, size: int, piece: int = 1 << 22) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one text, a piece at a time; the last words of a piece begin the next."""
    words, at, none = [], 0, True
    while at < len(text):
        gap = _SPACE.search(text, at + piece)
        end = gap.start() if gap else len(text)
        words += text[at:end].split()
        at = end
        if len(words) >= size:
            none = False
            yield _digests(words, size)
            words = words[len(words) - size + 1:]
    if none and words:
        yield _digests(words, len(words))


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), size):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(((total * 2 > n) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum()) if n else 0


def fingerprints(documents: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """All columns of ``documents`` and ``out``, the fingerprint as a signed long."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t, size) for t in texts(batch.column(text))], np.uint64)
            yield add_columns(batch, {out: pa.array(found.view(np.int64))})

    kept = documents.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.LongType())]))


def transpose(rows: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: ``out[block, bit]`` has the bit of all 64 lanes."""
    lanes = np.zeros(-(-len(rows) // 64) * 64, np.uint64)
    lanes[: len(rows)] = rows
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 64, 8).copy().view(np.uint64)[..., 0]


def _near(query: np.ndarray, block: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within ``radius`` (at most 7) of each query, for pairs of query and lane block; the numbers of the pairs left and their lane masks."""
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    alive = np.arange(len(query))
    c0, c1, c2, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    for bit in range(64):
        differ = planes[block[alive], bit] ^ (np.uint64(0) - ((query[alive] >> np.uint64(bit)) & one))
        c0, carry = c0 ^ differ, c0 & differ
        c1, carry = c1 ^ carry, c1 & carry
        c2, carry = c2 ^ carry, c2 & carry
        over |= carry
        if bit >= 7 and bit % 8 == 7:
            passed = over | _above(c0, c1, c2, radius)
            left = passed != full
            if not left.all():
                alive, c0, c1, c2, over = alive[left], c0[left], c1[left], c2[left], over[left]
                if not len(alive):
                    break
    return alive, ~(over | _above(c0, c1, c2, radius))


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is above ``radius``."""
    above, equal = np.zeros_like(c0), ~np.zeros_like(c0)
    for c, r in ((c2, radius >> 2 & 1), (c1, radius >> 1 & 1), (c0, radius & 1)):
        if not r:
            above |= equal & c
            equal &= ~c
        else:
            equal &= c
    return above


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Joins the trees of ``root`` along edges (a, b); every place points to the smallest of its tree."""
    while True:
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def group_links(key: np.ndarray, rows: np.ndarray, radius: int, chunk: int = 1 << 15) -> np.ndarray:
    """Place of the smallest connected row of the same key, for rows sorted by (key, row)."""
    n = len(rows)
    root = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]])
    size = last - first
    many = np.flatnonzero(np.repeat(size > 1, size))  # rows with company
    if not len(many):
        return root
    end = np.repeat(last, size)[many]
    planes = transpose(rows)
    # a row is compared with the lanes after it only, from its own lane block to the last one of its group
    from_block, to_block = many // 64, (end - 1) // 64
    count = to_block - from_block + 1
    upto = np.cumsum(count)
    for a in range(0, int(upto[-1]), chunk):
        pair = np.arange(a, min(a + chunk, int(upto[-1])))
        q = np.searchsorted(upto, pair, "right")
        row, block = many[q], from_block[q] + pair - (upto[q] - count[q])
        alive, mask = _near(rows[row], block, planes, radius)
        row, block, stop = row[alive], block[alive], end[q][alive]
        lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(lanes)
        other = block[at] * 64 + lane
        ok = (other > row[at]) & (other < stop[at])
        if ok.any():
            root = _roots(n, row[at][ok], other[ok], root)
    return root


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows that arrive sorted by (key, fingerprint); a group may reach over several batches."""
    keys, rows = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(k: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        root = group_links(k, r, radius)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(r[child].view(np.int64)), pa.array(r[root[child]].view(np.int64))], ["a", "b"])

    for batch in batches:
        k, r = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        keys, rows = np.concatenate([keys, k]), np.concatenate([rows, r])
        cut = int(np.searchsorted(keys[::-1] != keys[-1], True)) if len(keys) else 0
        cut = len(keys) - cut  # rows before the last, still open group
        if cut > 1 << 14:
            yield done(keys[:cut], rows[:cut])
            keys, rows = keys[cut:], rows[cut:]
    if len(keys):
        yield done(keys, rows)


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``blocks`` blocks of nearly equal width."""
    ends = [round(bits * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = 6, hot_rows: int = 1 << 14) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``), enough to connect all within ``radius`` bits."""
    cuts = _cuts(64, blocks)
    choices = list(combinations(range(blocks), blocks - radius))

    def part(cut: tuple[int, int]):
        return F.shiftrightunsigned("fp", cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1))

    keys = F.array(*[F.xxhash64(F.lit(i), *[part(cuts[b]) for b in choice]) for i, choice in enumerate(choices)])
    keyed = distinct.select("fp", F.posexplode(keys).alias("choice", "key"))
    crowded = materialize(keyed.groupBy("key", "choice").count().where(F.col("count") > hot_rows).select("key", "choice"), "crowded")
    if not crowded.isEmpty():
        # rows of a crowded group agree in the chosen blocks; of radius + 1 pieces of the other bits they agree in one, too
        pieces = F.array(*[F.array(*[F.xxhash64(F.lit(p), "key", *[part(c) for c in piece])
                                     for p, piece in enumerate(_rest(cuts, choice, radius + 1))]) for choice in choices])
        apart = keyed.join(crowded.withColumn("hot", F.lit(True)), ["key", "choice"], "left")
        split = F.when(F.col("hot"), F.element_at(pieces, F.col("choice") + 1)).otherwise(F.array("key"))
        keyed = apart.select("fp", F.explode(split).alias("key"))
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return sorted_.mapInArrow(lambda b: _compare(b, radius), "a long, b long")


def _rest(cuts: list[tuple[int, int]], choice: tuple[int, ...], pieces: int) -> list[list[tuple[int, int]]]:
    """The bits outside the chosen blocks in ``pieces`` pieces, each a list of bit ranges."""
    bits = [b for i, (at, width) in enumerate(cuts) if i not in choice for b in range(at, at + width)]
    out = []
    for a, n in _cuts(len(bits), pieces):
        ranges: list[tuple[int, int]] = []
        for b in bits[a:a + n]:
            if ranges and sum(ranges[-1]) == b:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((b, 1))
        out.append(ranges)
    return out


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (signed long) and ``component_id``, the smallest id of its group."""
    return _rooted(documents, doc_id, text, radius, blocks).select("doc_id", "fingerprint", "component_id")


def _rooted(documents: DataFrame, doc_id: str, text: str, radius: int, blocks: int = 6) -> DataFrame:
    """``groups`` and ``root``, which tells groups apart that have the same smallest id."""
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(own).select("doc_id", "fingerprint"), "prints")
    smallest = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(smallest.select("fp"), radius, blocks))
    rooted = smallest.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    by_print = materialize(rooted.join(heads, "root").select(F.col("fp").alias("fingerprint"), "component_id", "root"), "classes")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id", "root")


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group, the one with the smallest id. Of rows that share this id one stays, that of the smallest fingerprint and then the
    smallest row; rows with a null id stay. Rows that repeat an id with another text belong to the group of their own text."""
    # an id and a fingerprint together belong to one group, an id alone need not
    grouped = _rooted(documents, doc_id, text, radius).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_own"), "root")
    grouped = materialize(grouped.groupBy("_id", "_own", "root").count(), "grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct("_id", "_own", "count")).alias("_first"))
    stay = materialize(first.select("_first._id", "_first._own", "_first.count"), "stay")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    key = F.col(f"`{doc_id}`")
    tagged = fingerprints(documents, text, "_print")
    none = documents.where(key.isNull())

    def of(some: DataFrame) -> DataFrame:
        return tagged.join(some, (key == F.col("_id")) & (F.col("_print") == F.col("_own")), "left_semi")

    again = stay.where("count > 1")
    kept = none.unionByName(of(stay.where("count = 1")).select(*columns))
    if again.isEmpty():
        return kept
    one = of(again).groupBy(key.alias("_k"), "_print").agg(F.min(F.struct(*columns)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
