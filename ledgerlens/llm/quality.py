"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Units are the UTF-8 bytes of a text, unfolded, with four bytes of context: scripts, capitals, digits and the way words follow each other at their
seams all count. A text is preceded by zero bytes.

Counting: the texts are read in blocks of bounded size; a task hands on every different n-gram of a block once, with its count. The counts of
trusted blocks meet in a shuffle on the n-gram. No trusted text may judge itself: trusted texts fall into ``FOLDS`` folds by a hash of the text
(copies fall together), and besides the model of all trusted text there is one without each fold. A model's number is part of the key of its n-grams,
so all models go through the same joins. All trusted text counts, and the counts grow with it.

Scoring: the different n-grams that the corpus asks for are joined with the count tables, order by order: own counts on the n-gram, totals and
followers on the history, the shorter n-gram's probability on the tail. All tables are sharded by hash; none is sent to the driver or to all executors.
The found costs go back to the blocks that asked, where they meet the texts in one sorted stream: a block's costs first, then its texts one
batch after the other. An n-gram has at most one row per block, so no key is hot.

Decision: the perplexity per byte is taken from the mean cost rounded to four decimals. A text is rejected if it is above its language's threshold, the
exact quantile of the trusted texts of that language (from counts of the rounded values) times a margin. Languages without trusted texts have
the threshold of all trusted texts; a null language is one of these. Without any trusted text nothing is rejected. The same tables give the
same rows each time: sums are of whole numbers, or run in the order of the text.

Trusted are the rows that the label table marks 1; label rows with null fields count for nothing, repeated ones once. Null and empty texts have no
perplexity (null) and are kept, as there is nothing to hold against them. Repeated documents get equal results; an empty table gives no rows.
Columns named ``perplexity``, ``threshold`` or ``keep`` are replaced; any other name may occur in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import add_columns, bounded_batches, pieces, unused, utf8
from ledgerlens.session import discard, materialize

ORDER = 5
SYMBOLS = 256
MODEL = 8 * ORDER  # the bits of a key from here on are the number of the model
FOLDS = 2
QUANTILE = 0.995
MARGIN = 1.05
BROADCAST_IDS = 2_000_000
PIECE = 1 << 19  # bytes of text whose n-grams are held at a time
BLOCK = 32 << 20  # bytes of text that ask for an n-gram once


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte; a text is preceded by zero bytes."""
    code = data.astype(np.int64)
    out = code.copy()
    place = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER):
        back = np.zeros(len(code), np.int64)
        back[k:] = code[:-k]
        back[place < k] = 0
        out += back << (8 * k)
    return out


def keys(batch: pa.RecordBatch, text: str, model: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first, last, the keys of their n-grams on end, the offsets of the rows in them."""
    data, offsets = utf8(batch.column(text))
    models = batch.column(model).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in pieces(offsets, PIECE):
        own = offsets[a:b + 1] - offsets[a]
        yield a, b, grams(data[offsets[a]:offsets[b]], own) | np.repeat(models[a:b] << MODEL, np.diff(own)), own


def blocks(sizes: np.ndarray, part: int, before: int) -> tuple[np.ndarray, int]:
    """The block of each row of a partition: a new one begins after every ``BLOCK`` bytes. Second, the bytes so far."""
    upto = before + np.cumsum(sizes)
    return (part << 24) + (upto - sizes) // BLOCK, int(upto[-1]) if len(upto) else before


def _added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several tables of n-grams, each n-gram once."""
    gram, at = np.unique(np.concatenate([g for g, _ in tables]), return_inverse=True)
    total = np.zeros(len(gram), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in tables]))
    return gram, total


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", out: str = "trusted") -> DataFrame:
    return labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias(out)).distinct()


def marked(documents: DataFrame, trusted: DataFrame, doc_id: str, text: str, model: str, part: str) -> DataFrame:
    """All columns, the model that judges a row (0: all trusted text; else the one without the row's fold) and the partition that it is read in."""
    few = trusted.count() <= BROADCAST_IDS
    own = [F.col(f"`{c}`") for c in documents.columns]
    key = trusted.columns[0]
    joined = documents.join(F.broadcast(trusted) if few else trusted, F.col(f"`{doc_id}`") == F.col(key), "left")
    fold = 1 + F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(FOLDS))
    out = joined.select(*own, F.when(F.col(key).isNotNull(), fold).otherwise(0).cast("int").alias(model))
    if not few:  # after a shuffle, a second reading may find the rows in other partitions
        out = materialize(out, "marked")
    return out.withColumn(part, F.spark_partition_id())


def asked(docs: DataFrame, text: str, model: str, part: str) -> DataFrame:
    """``block``, ``gram``, ``n``: the different keys of every block and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, before = -1, 0

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram, n = _added(held)
            for a in range(0, len(gram), 1 << 16):
                size = len(gram[a:a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, now)), pa.array(gram[a:a + size]), pa.array(n[a:a + size])],
                                                 ["block", "gram", "n"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(utf8(batch.column(text))[1])
            block, before = blocks(sizes, batch.column(part)[0].as_py(), before)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if block[a] != now:
                    yield from done()
                    now = int(block[a])
                for _, _, key, _ in keys(batch.slice(a, b - a), text, model):
                    if len(key):
                        held.append(np.unique(key, return_counts=True))
                    if len(held) > 32:
                        held[:] = [_added(held)]
        yield from done()

    return docs.select(F.col(f"`{text}`"), F.col(model), F.col(part)).mapInArrow(run, "block long, gram long, n long")


def counts(needs: DataFrame) -> list[DataFrame]:
    """For each order from 1 up: ``gram``, ``n`` of every model; below the highest order the number of different bytes that precede."""
    low = F.lit((1 << MODEL) - 1)
    fold = F.shiftright("gram", MODEL)
    per_fold = [F.sum(F.when(fold == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(1, FOLDS + 1)]
    table = needs.where(fold > 0).groupBy(F.col("gram").bitwiseAND(low).alias("gram")).agg(*per_fold)
    everything = sum((F.col(f"n{i}") for i in range(1, FOLDS + 1)), F.lit(0))
    models = F.array(*[F.struct(F.lit(i << MODEL).alias("model"), (everything - (F.col(f"n{i}") if i else 0)).alias("n")) for i in range(FOLDS + 1)])
    rows = table.select("gram", F.explode(models).alias("m")).select(F.col("gram").bitwiseOR(F.col("m.model")).alias("gram"), F.col("m.n").alias("n"))
    tables = [materialize(rows.where("n > 0"), "grams")]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialize(tables[0].groupBy(tail(k + 1).alias("gram")).agg(F.count("*").alias("n")), "grams"))
    return tables


def _model_bits() -> Column:
    return F.shiftleft(F.shiftright("gram", MODEL), MODEL)


def tail(k: int) -> Column:
    """Key of an n-gram of order ``k`` without its first byte."""
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)).bitwiseOR(_model_bits())


def history(k: int) -> Column:
    """Key of an n-gram of order ``k`` without its last byte."""
    return F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)), 8).bitwiseOR(_model_bits())


def discounts(table: DataFrame) -> list[list[float]]:
    """For each model, what is taken off counts of 1, 2, and 3 or more, from how many n-grams occur once to four times (a few numbers)."""
    model = F.shiftright("gram", MODEL).alias("model")
    found = {(r["model"], r["n"]): r["k"] for r in table.where("n <= 4").groupBy(model, "n").agg(F.count("*").alias("k")).collect()}
    out = []
    for m in range(FOLDS + 1):
        n1, n2, n3, n4 = (found.get((m, i), 0) for i in range(1, 5))
        if not (n1 and n2 and n3):
            out.append([0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out.append([float(np.clip(d, 0.05, k + 0.95)) for k, d in enumerate(raw)])
    return out


def probabilities(wanted: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``gram``, ``p``: interpolated probability of every wanted key, by joins with the count tables of each order."""
    levels = [materialize(wanted, "wanted")]
    for k in range(ORDER, 1, -1):
        levels.insert(0, materialize(levels[0].select(tail(k).alias("gram")).distinct(), "wanted"))
    p = None
    for k, (level, table) in enumerate(zip(levels, tables), 1):
        per_model = discounts(table)
        d = [F.element_at(F.array(*[F.lit(x[i]) for x in per_model]), (F.shiftright("gram", MODEL) + 1).cast("int")) for i in range(3)]
        once, twice, more = F.col("n") == 1, F.col("n") == 2, F.col("n") > 2
        histories = table.groupBy(history(k).alias("h")).agg(F.sum("n").alias("total"), F.count_if(once).alias("n1"),
                                                             F.count_if(twice).alias("n2"), F.count_if(more).alias("n3"))
        joined = level.withColumn("h", history(k)).withColumn("tail", tail(k)).join(table, "gram", "left").join(histories, "h", "left")
        if p is None:
            joined = joined.withColumn("q", F.lit(1 / SYMBOLS))
        else:
            joined = joined.join(p.toDF("tail", "q"), "tail")
        own = F.coalesce((F.col("n") - F.when(once, d[0]).when(twice, d[1]).otherwise(d[2])) / F.col("total"), F.lit(0.0))
        lower = F.coalesce((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total"), F.lit(1.0))
        below, p = p, materialize(joined.select("gram", (own + lower * F.col("q")).alias("p")), "p")
        discard(level, *([below] if below is not None else []))
    return p


def costs(needs: DataFrame) -> DataFrame:
    """``block``, ``gram``, ``cost``: the negative logarithm of the probability of every key that a block asks for. ``needs`` is stored; it goes."""
    tables = counts(needs)
    p = probabilities(needs.select("gram").distinct(), tables)
    discard(*tables)
    found = materialize(needs.select("block", "gram").join(p, "gram").select("block", "gram", (-F.log("p")).cast("float").alias("cost")), "costs")
    discard(needs, p)
    return found


def score(docs: DataFrame, found: DataFrame, text: str, model: str, part: str, out: str, trusted_only: bool = False) -> DataFrame:
    """All columns but ``part``, and the mean cost per byte of the whole text to four decimals, null for a text without bytes.

    Costs and texts of a block meet in one partition, sorted so that the costs come first; a task holds the costs of one block and a batch of texts.
    """
    block, kind, gram, cost = unused([*docs.columns, out], "block", "kind", "gram", "cost")
    fields = [f for f in docs.schema.fields if f.name != part]
    given = [F.col(f"`{f.name}`") for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            if batch.num_rows:
                own, before = blocks(np.diff(utf8(batch.column(text))[1]), batch.column(part)[0].as_py(), before)
                yield add_columns(batch.drop_columns([part]), {block: pa.array(own)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for batch in batches:
            own, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (block, kind))
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != now:
                    now, parts, table = own[a], [], None
                some = batch.slice(a, b - a)
                if not kinds[a]:
                    parts.append((some.column(gram).to_numpy(), some.column(cost).to_numpy()))
                    continue
                if table is None:
                    all_keys = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in parts]])
                    order = np.argsort(all_keys)
                    table = all_keys[order], np.concatenate([np.zeros(0, np.float32), *[x for _, x in parts]])[order].astype(np.float64)
                    parts = []
                mean, empty = np.zeros(some.num_rows), np.ones(some.num_rows, bool)
                for x, y, key, offsets in keys(some, text, model):
                    if len(key):
                        different, at = np.unique(key, return_inverse=True)
                        where = np.minimum(np.searchsorted(table[0], different), len(table[0]) - 1)
                        if not len(table[0]) or (table[0][where] != different).any():
                            raise ValueError("documents were read in another order the second time; store them first")
                        upto = np.concatenate([[0], np.cumsum(table[1][where][at])])
                        mean[x:y] = np.diff(upto[offsets]) / np.maximum(np.diff(offsets), 1)
                        empty[x:y] = np.diff(offsets) == 0
                yield add_columns(some.select([f.name for f in fields]), {out: pa.array(np.round(mean, 4), mask=empty)})

    placed = docs.mapInArrow(place, T.StructType([*fields, T.StructField(block, T.LongType())]))
    if trusted_only:
        placed = placed.where(F.col(model) > 0)
    rows = placed.select(*given, block, F.lit(1).alias(kind), F.lit(None).cast("long").alias(gram), F.lit(None).cast("float").alias(cost))
    table = found.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.col("block").alias(block), F.lit(0).alias(kind),
                         F.col("gram").alias(gram), F.col("cost").alias(cost))
    together = table.unionAll(rows).repartition(F.col(block)).sortWithinPartitions(block, kind)
    return together.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(out, T.DoubleType())]))


def limits(known: DataFrame, quantile: float, margin: float) -> DataFrame:
    """``lang``, ``limit``: margin times the exact quantile of the perplexities of each language, and of all under null.

    ``known`` has ``lang`` and the rounded ``mean``, which takes a bounded number of values, so its counts are few.
    """
    each = known.where("lang is not null").groupBy("lang", "mean").agg(F.count("*").alias("n"))
    both = each.unionAll(known.groupBy("mean").agg(F.count("*").alias("n")).select(F.lit(None).cast(each.schema["lang"].dataType), "mean", "n"))
    own = Window.partitionBy("lang")
    upto = both.select("lang", "mean", F.sum("n").over(own.orderBy("mean")).alias("upto"), F.sum("n").over(own).alias("total"))
    reached = upto.where(F.col("upto") >= F.ceil(F.col("total") * F.lit(quantile)))
    return reached.groupBy("lang").agg((F.exp(F.min("mean")) * margin).alias("limit"))


def judge(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          quantile: float = QUANTILE, margin: float = MARGIN, stored: bool = False) -> DataFrame:
    """All columns of ``documents`` with ``perplexity``, ``threshold`` and ``keep``.

    The texts are read twice and must lie in the same partitions both times. That is so for a table read from files: ``stored`` says that
    ``documents`` is one. Other input is stored first.
    """
    spark = documents.sparkSession
    bounded_batches(spark, rows=1 << 16)
    own = documents.drop("perplexity", "threshold", "keep")
    if not stored:
        own = materialize(own, "documents")
    model, part, mean, key, value, trusted = unused([*own.columns, "perplexity", "threshold", "keep"],
                                                    "model", "part", "mean", "key", "value", "trusted")
    docs = marked(own, materialize(trusted_ids(labels, doc_id, out=trusted), "trusted"), doc_id, text, model, part)
    found = costs(materialize(asked(docs, text, model, part), "asked"))
    slim = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`"), model, part)
    few = found.where(F.shiftright("gram", MODEL) > 0)
    known = score(slim, few, text, model, part, mean, trusted_only=True)
    by = materialize(limits(materialize(known.where(F.col(mean).isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(mean).alias("mean")),
                                        "known"), quantile, margin), "limits")
    anyway = [r["limit"] for r in by.where("lang is null").collect()]
    judged = score(docs, found, text, model, part, mean)
    joined = judged.join(by.where("lang is not null").toDF(key, value), F.col(f"`{lang}`") == F.col(key), "left")
    threshold = F.coalesce(F.col(value), F.lit(anyway[0] if anyway else None).cast("double"))
    perplexity = F.exp(mean)
    return joined.select(*[F.col(f"`{c}`") for c in own.columns], perplexity.alias("perplexity"), threshold.alias("threshold"),
                         F.coalesce(perplexity <= threshold, F.lit(True)).alias("keep"))
