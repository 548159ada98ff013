"""Benchmark decontamination by suffix arrays over the training texts.

Every block of documents that a task reads is a shard: its words become numbers, and a suffix array orders the places where a
benchmark window can start at all (places whose following words all occur in the benchmark). Every benchmark suffix long
enough to hold a window is then found in every shard by binary search; the interval it gives are all its occurrences. Runs of
neighbouring occurrences on one diagonal are the longest verbatim matches.

Documents are read once, are never shuffled, and one document may be of any length. The benchmark is cut into parts of at most
``part_bytes`` bytes of text, each broadcast by itself, so a broadcast has that bound whatever the size of the benchmark; more
parts mean more searches of the same shards.

Words are lower-cased in A-Z and are runs of digits, letters and characters outside ASCII. A null text has no words. An item without words
is never found; an item of fewer words than the window counts as one window. Repeated documents each get their own result, repeated
items each their own entry; an item with a null id is listed as -1. An empty benchmark or document table gives zero hits or no rows. Words are compared by 64-bit
hashes with their length; only benchmark words are looked up, so a false match has a chance below 1e-6 even for a
billion different words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.bytewords import Lookup, words
from ledgerlens.llm.common import add_columns, bounded_batches, pieces, utf8

WINDOW = 10
#: Columns that ``find`` adds. ``hit_spans`` holds hit word ranges [start, end); ``longest`` the longest verbatim match.
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("longest_words", T.LongType()), T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.LongType()),
])


class Benchmark:
    """Items as word numbers, and their windows."""

    def __init__(self, rows: list[tuple[int | None, str | None]], window: int):
        ids = [i for i, _ in rows]
        data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
        w = words(data, offsets)
        self.lookup = Lookup(w.hash)
        self.numbers = (self.lookup(w.hash) + 1).astype(np.int64)  # 0 stands for any other word
        count = np.bincount(w.text, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
        length = np.minimum(count, window)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        n = np.where(count > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(rows)), n)
        self.start = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        self.length = length[item]
        self.item = np.array([-1 if i is None else i for i in ids], np.int64)[item]
        self.row = item
        self.shortest = int(length[count > 0].min()) if (count > 0).any() else 0


def suffix_array(numbers: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """Places with a number above 0 in the order of the next ``depth`` numbers, by prefix doubling.

    ``run`` is how many numbers above 0 follow in the same stretch, the place itself included.
    """
    rank, k = numbers, 1
    while k < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-k] = rank[k:]
        follow[run <= k] = 0
        _, rank = np.unique(rank * (rank.max() + 1) + follow, return_inverse=True)
        rank = rank + 1
        rank[numbers == 0] = 0
        k *= 2
    places = np.flatnonzero(numbers)
    return places[np.argsort(rank[places], kind="stable")]


def _bound(shard: np.ndarray, order: np.ndarray, bench: Benchmark, upper: bool) -> np.ndarray:
    """First place in ``order`` whose suffix is not below (``upper``: is above) each window."""
    width = int(bench.length.max())
    steps = np.arange(width)
    lo, hi = np.zeros(len(bench.start), np.int64), np.full(len(bench.start), len(order), np.int64)
    inside = steps[None, :] < bench.length[:, None]
    wanted = np.where(inside, bench.numbers[np.minimum(bench.start[:, None] + steps, len(bench.numbers) - 1)], 0)
    for _ in range(int(len(order)).bit_length()):
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        have = np.where(inside[open_], shard[order[mid][:, None] + steps], 0)
        differ = have != wanted[open_]
        at = differ.argmax(1)
        row = np.arange(len(open_))
        less = have[row, at] < wanted[open_][row, at]
        go_up = np.where(differ[row, at], less, upper)
        lo[open_] = np.where(go_up, mid + 1, lo[open_])
        hi[open_] = np.where(go_up, hi[open_], mid)
    return lo


def _occurrences(w, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """All (word place in the block, window number) pairs of one block of texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(w.hash) or not bench.shortest:
        return none
    numbers = bench.lookup(w.hash) + 1
    last = np.ones(len(numbers), bool)
    last[:-1] = w.text[1:] != w.text[:-1]
    stop = last | (numbers == 0)  # a stretch ends with the text or at a word that no item has
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, np.arange(len(numbers)))]
    run = end - np.arange(len(numbers)) + (numbers[end] > 0)
    run[numbers == 0] = 0
    start_of_run = np.concatenate([[0], ends[:-1] + 1])
    whole = run[start_of_run]
    keep_run = whole >= bench.shortest
    if not keep_run.any():
        return none
    s, n = start_of_run[keep_run], whole[keep_run]
    # the kept stretches on end, with a break after each
    place = np.repeat(s - np.concatenate([[0], np.cumsum(n + 1)[:-1]]), n + 1) + np.arange((n + 1).sum())
    breaks = np.cumsum(n + 1) - 1
    place[breaks] = 0
    shard, left = numbers[place], run[place]
    shard[breaks] = 0
    left[breaks] = 0
    order = suffix_array(shard, left, int(bench.length.max()))
    order = order[left[order] >= bench.shortest]
    padded = np.concatenate([shard, np.zeros(int(bench.length.max()), np.int64)])
    lo, hi = _bound(padded, order, bench, False), _bound(padded, order, bench, True)
    found = hi - lo
    window = np.repeat(np.arange(len(lo)), found)
    at = np.repeat(lo, found) + (np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found))
    return place[order[at]], window


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list per text from values sorted by their owner."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [first, last) that overlap or touch, joined."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return first[at], last[np.concatenate([at[1:] - 1, [len(last) - 1]])] if len(at) else last


def _search(batch: pa.RecordBatch, text: str, bench: Benchmark) -> pa.RecordBatch:
    n = batch.num_rows
    data, offsets = utf8(batch.column(text))
    w = words(data, offsets)
    count = np.bincount(w.text, minlength=n)
    base = np.cumsum(count) - count
    place, window = _occurrences(w, bench)
    # hit words
    first, last = _merged(place, place + bench.length[window]) if len(place) else (place, place)
    owner = w.text[first] if len(first) else first
    # a text's ranges never touch those of the next one's: ranges are cut where the text changes
    cut = [(a, b) for a, b in zip(first, last)]
    if len(first) and (w.text[last - 1] != owner).any():
        cut = []
        for a, b in zip(first, last):
            while w.text[b - 1] != w.text[a]:
                e = int(base[w.text[a]] + count[w.text[a]])
                cut.append((a, e))
                a = e
            cut.append((a, b))
    spans = np.array(cut, np.int64).reshape(-1, 2)
    owner = w.text[spans[:, 0]] if len(spans) else np.zeros(0, np.int64)
    local = spans - base[owner][:, None]
    # items
    pair = np.unique(np.stack([w.text[place], bench.row[window]], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
    item_of_row = np.zeros(int(bench.row.max(initial=-1)) + 1, np.int64)
    item_of_row[bench.row] = bench.item
    # longest verbatim match: neighbouring windows on one diagonal
    longest, where, which = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if len(place):
        diagonal = place - bench.start[window]
        order = np.lexsort([place, diagonal, bench.row[window]])
        p, d, r = place[order], diagonal[order], bench.row[window][order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (w.text[p[1:]] != w.text[p[:-1]])
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(p)]])) - 1 + bench.length[window[order][at]]
        best = np.lexsort([p[at], -size, w.text[p[at]]])
        t = w.text[p[at]][best]
        head = np.concatenate([[True], t[1:] != t[:-1]])
        t, best = t[head], best[head]
        longest[t], where[t], which[t] = size[best], p[at][best] - base[t], bench.item[window[order][at][best]]
    none = longest == 0
    return add_columns(batch, {
        "n_words": pa.array(count, pa.int64()),
        "n_hit": pa.array(np.bincount(owner, weights=(spans[:, 1] - spans[:, 0]), minlength=n).astype(np.int64)),
        "items": _lists(pair[:, 0], item_of_row[pair[:, 1]], n),
        "hit_spans": _lists(np.repeat(owner, 2), local.reshape(-1), n),
        "longest_words": pa.array(longest), "longest_at": pa.array(where, mask=none), "longest_item": pa.array(which, mask=none),
    })


def _combined(old: pa.RecordBatch, new: pa.RecordBatch) -> pa.RecordBatch:
    """Results of two parts of the benchmark for the same rows."""
    a, b = (x.select([f.name for f in RESULT]).to_pylist() for x in (old, new))
    rows = []
    for x, y in zip(a, b):
        flat = np.array([*x["hit_spans"], *y["hit_spans"]], np.int64).reshape(-1, 2)
        first, last = _merged(flat[:, 0], flat[:, 1]) if len(flat) else (flat[:, 0], flat[:, 1])
        best = max(x, y, key=lambda z: z["longest_words"])
        rows.append({"n_words": x["n_words"], "n_hit": int((last - first).sum()), "items": [*x["items"], *y["items"]],
                     "hit_spans": np.stack([first, last], 1).reshape(-1).tolist(), **{k: best[k] for k in best if "longest" in k}})
    schema = pa.schema([new.schema.field(f.name) for f in RESULT])
    table = pa.RecordBatch.from_pylist(rows, schema)
    return add_columns(old, {f.name: table.column(f.name) for f in RESULT})


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, part_bytes: int = 16 << 20) -> DataFrame:
    """All columns of ``documents`` and those of ``RESULT``; columns of ``documents`` with these names are replaced."""
    spark = documents.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    parts = -(-size // part_bytes) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    found = documents.drop(*[f.name for f in RESULT])
    for k in range(parts):
        bench = Benchmark([tuple(r) for r in items.where(part == k).collect()], window)
        shared = spark.sparkContext.broadcast(bench)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, offsets = utf8(batch.column(text))
                for a, b in pieces(offsets, 8 << 20):
                    own = batch.slice(a, b - a)
                    new = _search(own, text, shared.value)
                    yield _combined(own, new) if again else new

        schema = T.StructType([*[f for f in found.schema if f.name not in RESULT.names], *RESULT])
        found = found.mapInArrow(search, schema)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any benchmark item occurs."""
    return find(documents, benchmark, **options).where("n_hit = 0").select(*[F.col(f"`{c}`") for c in documents.columns])
