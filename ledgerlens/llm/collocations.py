"""Phrase collocations by sorted count streams.

Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs; phrases do not cross pieces. All counts are per
language (null: ``und``) and cover every occurrence, overlaps included.

Counting takes four passes over the texts: words; pairs whose words are frequent; triples whose pairs are; phrases of four to ``most`` words whose triples are all
frequent. A phrase is no more frequent than any part of it, so nothing frequent is lost. What is frequent is told to the tasks by a bit table of fixed size (``bits``), which lets a few others through; the counts
themselves are exact. Tasks hand on counts per block of text, which Spark adds up before and after the shuffle, so a text or word that fills a third of the table
weighs no more than any other.

Streams: the counts of all lengths together are range partitioned and sorted by their words from the first to the last (prefix order) and read once, in
lockstep: the phrases that begin a phrase stand right before it, so a stack of at most ``most`` entries knows the counts of all its first parts, and each phrase
sees the greatest count of its extensions to the right before the stream leaves it. Sorted by their words from the last to the first (suffix order) the same
gives the counts of all last parts and of the extensions to the left. Nothing is looked up by a hash. Where a range begins inside a phrase's extensions, the phrase is not in the range; these are at most
``most - 1`` per range, and their counts are handed out to the rows that miss them.

Scores are whole numbers of any size. Words are known by 64-bit hashes inside the streams and spelled out at the end; two of a million different words share a hash with a chance of 3e-8.

Null and empty texts have no words. Repeated texts count each. An empty table, or one without frequent phrases, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bytewords import LOWER, Words, words
from ledgerlens.llm.common import Bits, bit_set, bounded_batches, pieces, utf8
from ledgerlens.session import materialize

LEAST = 100
MOST = 5
TOP = 2000
BLOCK = 1 << 20  # bytes of text that are counted at a time
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\v\f\r")] = True
WORD = ~BREAK
WORD[list(b" \t")] = False
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Words, np.ndarray, np.ndarray]]:
    """Bytes, words, piece of each word and language of each word, for at most ``BLOCK`` bytes or one longer piece at a time."""
    data, offsets = utf8(batch.column("text"))
    lang = batch.column("lang").dictionary_encode() if not pa.types.is_dictionary(batch.column("lang").type) else batch.column("lang")
    code = lang.indices.to_numpy(zero_copy_only=False)
    for a, b in pieces(offsets, BLOCK):
        if b - a > 1 or offsets[b] - offsets[a] <= BLOCK:
            yield _block(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], code[a:b])
            continue
        at, end = int(offsets[a]), int(offsets[b])
        while at < end:  # a long text is cut between pieces
            to = min(at + BLOCK, end)
            while to < end and not (gap := BREAK[data[to:to + BLOCK]]).any():
                to += len(gap)
            if to < end:
                to += int(gap.argmax()) + 1
            yield _block(data[at:to], np.array([0, to - at]), code[a:b])
            at = to


def _block(data: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    w = words(data, offsets, WORD)
    piece = np.cumsum(BREAK[data], dtype=np.int32)[w.start] if len(w.start) else np.zeros(0, np.int32)
    return data, w, piece, code[w.text]


def _names(batch: pa.RecordBatch) -> list[str]:
    return batch.column("lang").dictionary_encode().dictionary.to_pylist()


def _language_hash(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))


def _key(lang: np.ndarray, *word: np.ndarray) -> np.ndarray:
    """One 64-bit key of a language and some words."""
    with np.errstate(over="ignore"):
        key = lang ^ word[0] * _LEFT
        for w in word[1:]:
            key = (key ^ (key >> np.uint64(29))) * _RIGHT + w * _LEFT
        return key


def _own(documents: DataFrame, text: str, lang: str) -> DataFrame:
    return documents.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang")).where("length(text) > 0")


def count_words(documents: DataFrame) -> DataFrame:
    """``lang``, ``w1``, ``word``, ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(_names(batch), object)
            for data, w, _, lang in _blocks(batch):
                for c in np.unique(lang).tolist():
                    own = np.flatnonzero(lang == c)
                    hashes, first, n = np.unique(w.hash[own], return_index=True, return_counts=True)
                    low, first = LOWER[data].tobytes(), own[first]
                    spelled = [low[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([names[c]] * len(n), pa.string()), pa.array(hashes.view(np.int64)),
                                                      pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "w1", "word", "f"])

    counted = documents.mapInArrow(run, "lang string, w1 long, word string, f long")
    return counted.groupBy("lang", "w1").agg(F.min("word").alias("word"), F.sum("f").alias("f"))


def count_phrases(documents: DataFrame, known: Bits, least: int, most: int) -> DataFrame:
    """``lang``, ``w1`` to ``w<most>`` (null beyond the end), ``f`` of the phrases of ``least`` to ``most`` words whose parts of ``least - 1`` words are all ``known``."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    columns, size = [f"w{i}" for i in range(1, most + 1)], least - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _names(batch)
            hashed = np.array([_language_hash(x) for x in names], np.uint64)
            for _, w, piece, lang in _blocks(batch):
                count = len(w.hash) - size + 1
                if count < 2:
                    continue
                near = np.zeros(len(w.hash) + most, bool)  # the next word is in the same piece
                near[:len(w.hash) - 1] = (piece[1:] == piece[:-1]) & (w.text[1:] == w.text[:-1])
                ok = np.zeros(len(near), bool)  # a known part begins here
                ok[:count] = shared.value(_key(hashed[lang[:count]], *[w.hash[i:count + i] for i in range(size)]))
                for i in range(size - 1):
                    ok[:count] &= near[i:count + i]
                at = np.flatnonzero(ok[:-1] & ok[1:])
                at = at[near[at + size - 1]]
                _, word = np.unique(w.hash, return_inverse=True)
                span = int(word.max()) + 1
                group = lang[at] * span + word[at]
                for n in range(2, most + 1):  # numbers of the phrases that begin at each place, word by word
                    if n > least:
                        longer = ok[at + n - size] & near[at + n - 2]
                        at, group = at[longer], group[longer]
                    if not len(at):
                        break
                    _, first, group, f = np.unique(group * span + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                    if n >= least:
                        begin = at[first]
                        yield pa.RecordBatch.from_arrays(
                            [pa.DictionaryArray.from_arrays(pa.array(lang[begin].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()),
                             *[pa.array(w.hash[begin + i].view(np.int64)) if i < n else pa.nulls(len(begin), pa.int64()) for i in range(most)],
                             pa.array(f, pa.int64())], ["lang", *columns, "f"])

    counted = documents.mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in columns)}, f long")
    return counted.groupBy("lang", *columns).agg(F.sum("f").alias("f"))


def _known(frequent: DataFrame, n: int, bits: int) -> Bits:
    """Bit table of frequent phrases of ``n`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([_language_hash(x) for x in batch.column("lang").to_pylist()], np.uint64)
            key = _key(lang, *[batch.column(f"w{i + 1}").to_numpy(zero_copy_only=False).view(np.uint64) for i in range(n)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return bit_set(frequent.mapInArrow(run, "key long"), bits)


def frequent_phrases(documents: DataFrame, least: int, most: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of all lengths (``lang``, ``p``: the hashes of their words, ``f``); spelled words (``lang``, ``w``, ``word``); ``lang``, ``n``."""
    vocabulary = materialize(count_words(documents), "words")
    total = materialize(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = vocabulary.where(F.col("f") >= least)
    found = often.select("lang", F.array("w1").alias("p"), "f")
    known, n = _known(often, 1, bits), 2
    while n <= most:
        upto = min(n, most) if n < 4 else most
        counted = materialize(count_phrases(documents, known, n, upto).where(F.col("f") >= least), "phrases")
        found = found.unionByName(counted.select("lang", F.array_compact(F.array(*[f"w{i}" for i in range(1, upto + 1)])).alias("p"), "f"))
        if upto < most:
            known = _known(counted, n, bits)
        n = upto + 1
    return found, often.select("lang", F.col("w1").alias("w"), "word"), total


def lockstep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Reads phrases in order: language, words, count (or None), greatest extension seen on the other side, counts of the parts of the other side.

    Gives each phrase once, when the stream leaves it, as language, words, count, greatest count of its extensions by one word in this order, the
    counts of its parts from the shortest on, and the two values of the other side. Phrases that are only there as parts of others come with count None, and None stands for their counts.
    """
    stack: list[list] = []
    for lang, key, f, other, parts in rows:
        same = 0
        if stack and stack[0][0] == lang:
            top = stack[-1][1]
            while same < min(len(top), len(key)) and top[same] == key[same]:
                same += 1
        while len(stack) > same:
            yield tuple(stack.pop())
        while len(stack) < len(key):
            stack.append([lang, key[:len(stack) + 1], None, 0, [x[2] for x in stack], 0, None])
        here = stack[-1]
        here[5] = max(here[5], other or 0)
        if f is not None:
            here[2], here[6] = f, parts
            if len(stack) > 1:
                stack[-2][3] = max(stack[-2][3], f)
    while stack:
        yield tuple(stack.pop())


def _streamed(phrases: DataFrame, backwards: bool) -> DataFrame:
    """One pass in prefix order, which fills in ``right`` and ``l``, or in suffix order, which fills in ``left`` and ``r``."""
    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("lang", pa.string()), ("p", longs), ("f", long), ("right", long), ("l", longs), ("left", long), ("r", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x["lang"], tuple(x["o"]), x["f"], x["right"], x["l"]) for batch in batches for x in batch.to_pylist())
        held: list[dict] = []
        for lang, key, f, extension, before, other, parts in lockstep(rows):
            parts_here = None if f is None else before
            held.append({"lang": lang, "p": key[::-1], "f": f, "right": other, "l": parts, "left": extension, "r": parts_here} if backwards else
                        {"lang": lang, "p": key, "f": f, "right": extension, "l": parts_here, "left": None, "r": None})
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    ranges = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = phrases.withColumn("o", F.reverse("p") if backwards else F.col("p")).repartitionByRange(ranges, "lang", "o").sortWithinPartitions("lang", "o")
    return sorted_.select("lang", "o", "f", "right", "l").mapInArrow(
        run, "lang string, p array<long>, f long, right long, l array<long>, left long, r array<long>")


def _first(rows: DataFrame, group: list[str | Column], order: list[Column], k: int, out: str = "_r") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, top: int = TOP, bits: int = 25) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` phrases of 2 to ``most`` words that occur ``least`` times.

    A phrase of count ``a`` is cut in two so that ``floor(1000 * a * n / (l * r))`` is lowest; phrases that always occur inside the same longer one are left out.
    """
    bounded_batches(documents.sparkSession, 4 << 20)
    found, vocabulary, total = frequent_phrases(_own(documents, text, lang), least, most, bits)
    none = F.lit(None)
    forwards = materialize(_streamed(found.withColumns({"right": none.cast("long"), "l": none.cast("array<long>")}), False), "prefixes")
    both = materialize(_streamed(forwards, True), "suffixes")
    # phrases that are not in a range that has extensions of them: at most most - 1 for each range of either order
    absent = forwards.where("f IS NULL").select("lang", "p").union(both.where("f IS NULL").select("lang", "p")).distinct()
    missing = {(r["lang"], tuple(r["p"])): r["f"] for r in found.join(F.broadcast(absent), ["lang", "p"], "left_semi").collect()}
    whole = both.groupBy("lang", "p").agg(F.max("f").alias("f"), F.max("right").alias("right"), F.max("left").alias("left"),
                                          F.first("l", True).alias("l"), F.first("r", True).alias("r"))
    candidates = whole.where((F.size("p") >= 2) & (F.col("right") < F.col("f")) & (F.col("left") < F.col("f"))).join(total, "lang")
    shared = documents.sparkSession.sparkContext.broadcast(missing)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                p, lang = tuple(x["p"]), x["lang"]
                left = [shared.value[lang, p[:k + 1]] if c is None else c for k, c in enumerate(x["l"])]
                right = [shared.value[lang, p[len(p) - k - 1:]] if c is None else c for k, c in enumerate(x["r"])]
                value, _, l, r = min((1000 * x["f"] * x["n"] // (l * r), k, l, r) for k, (l, r) in enumerate(zip(left, reversed(right))))
                out.append({"lang": lang, "p": p, "a": x["f"], "l": l, "r": r, "n": x["n"], "score": value})
            yield pa.RecordBatch.from_pylist(out, schema)

    long = pa.int64()
    schema = pa.schema([("lang", pa.string()), ("p", pa.list_(long)), ("a", long), ("l", long), ("r", long), ("n", long), ("score", long)])
    values = candidates.select("lang", "p", "f", "l", "r", "n").mapInArrow(scored, "lang string, p array<long>, a long, l long, r long, n long, score long")
    values = materialize(values, "scored")
    spelled = (values.select("lang", "p", F.posexplode("p").alias("i", "w")).join(vocabulary, ["lang", "w"]).groupBy("lang", "p")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    named = values.join(spelled, ["lang", "p"])
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    fewer = _first(named, ["lang", F.pmod(F.xxhash64("p"), F.lit(64))], order, top)  # a language that has most of the phrases is cut down in many tasks first
    best = _first(fewer, ["lang"], order, top, "rank")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
