"""Language identification by cross-parsing entropy.

Each language has a suffix automaton over a bounded sample of its labelled text. A text is parsed greedily into the longest
phrases that occur in a language's sample; a language whose sample shares longer stretches needs fewer phrases. The number of phrases,
times the logarithm of the sample's length, over the length of the text is the cross entropy estimate; the language with the lowest wins.

Automata become tables of next states whose entries also say whether a phrase begins, so that thousands of stretches of text are parsed
side by side with array operations. A text of any length is parsed whole; a phrase also ends after every ``STRETCH`` symbols, for all
languages alike.

Symbols are the lower-cased UTF-8 bytes of letters; any run of other ASCII characters is one separator. The model is fitted on at most
``sample_docs`` different texts per language (expected number, drawn by hash from all), of long ones windows of ``sample_chars`` characters together, and on equal
shares of these, ``sample_symbols`` symbols per language; its size, which is broadcast, is bounded by languages x 2 x sample_symbols x symbols x 4 bytes.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing is labelled; rows with a null language teach
nothing. Ties go to the language that comes first in the alphabet. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import add_columns, bounded_batches, held_out, pieces, texts, utf8

STRETCH = 256
WINDOWS = 20  # of a long text
PIECE = 500  # symbols of a text on end, if its share has more than one piece
SEPARATOR = 0x20
_LETTER = re.compile(r"[^\W\d_]")
_BEGINS = np.int32(1 << 30)

_FOLD = np.full(256, SEPARATOR, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of lower-cased texts, one separator for each run of others, and the offsets of the texts in them."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != SEPARATOR) | (folded[:-1] != SEPARATOR)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[filled] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], upto[offsets]


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``sample``; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in sample:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def table(sample: bytes, code: np.ndarray, width: int) -> np.ndarray:
    """Next state of (state, symbol) on end, with ``_BEGINS`` added where a phrase begins; symbol 0 is any unseen one."""
    step = automaton(sample)
    root = np.full(width, _BEGINS, np.int32)
    for c, to in step[0].items():
        root[code[c]] = _BEGINS + to
    out = np.tile(root, (len(step), 1))
    for s, edges in enumerate(step[1:], 1):
        for c, to in edges.items():
            out[s, code[c]] = to
    return out.reshape(-1)


class Model:
    """Languages in alphabetical order, their tables, and the code of each byte."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(k for k in samples if samples[k])
        seen = sorted(set(b"".join(samples[k] for k in self.languages)))
        self.width = len(seen) + 1
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.tables = [table(samples[k], self.code, self.width) for k in self.languages]
        self.cost = np.array([np.log2(max(len(samples[k]), 2)) for k in self.languages])

    def phrases(self, coded: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases per text and language."""
        n = np.diff(offsets)
        stretches = -(-n // STRETCH)
        owner = np.repeat(np.arange(len(n)), stretches)
        first = np.repeat(offsets[:-1] - STRETCH * (np.cumsum(stretches) - stretches), stretches) + STRETCH * np.arange(len(owner))
        size = np.minimum(STRETCH, offsets[1:][owner] - first)
        order = np.argsort(-size, kind="stable")
        owner, first, size = owner[order], first[order], size[order]
        out = np.zeros((len(n), len(self.languages)), np.int64)
        state = np.zeros((len(self.languages), len(first)), np.int32)
        begun = np.zeros((len(self.languages), len(first)), np.int32)
        active = np.searchsorted(-size, -np.arange(1, STRETCH + 1), "right")  # stretches longer than each step
        for t in range(int(size[0]) if len(size) else 0):
            k = active[t]
            symbol = coded[first[:k] + t]
            for j, steps in enumerate(self.tables):
                entry = steps[state[j, :k] * np.int32(self.width) + symbol]
                begun[j, :k] += entry >> 30
                state[j, :k] = entry & (_BEGINS - 1)
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, weights=begun[j], minlength=len(n))
        return out

    def predict(self, many: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        lettered = np.array([bool(_LETTER.search(t)) for t in many], bool)
        names, score = ["und"] * len(many), np.zeros(len(many))
        if not self.languages or not lettered.any():
            return names, score
        data, offsets = utf8(pa.array([t.lower() for t in many], pa.large_string()))
        folded, bounds = symbols(data, offsets)
        entropy = self.phrases(self.code[folded], bounds) * self.cost / np.maximum(np.diff(bounds), 1)[:, None]
        best = entropy.argmin(1)
        least = np.maximum(entropy.min(1, keepdims=True), 1e-12)
        weight = np.exp(-8 * (entropy / least - 1))
        share = 1 / weight.sum(1)
        for i in np.flatnonzero(lettered):
            names[i], score[i] = self.languages[best[i]], share[i]
        return names, score


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 200,
        sample_chars: int = 20_000, sample_symbols: int = 20_000) -> Model:
    """Model of the languages of ``labelled``."""
    usable = labelled.select(F.sha2(F.col(text).cast("binary"), 256).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("l").isNotNull() & (F.length("t") > 0))
    counts = {r["l"]: r["count"] for r in usable.select("l", "k").distinct().groupBy("l").count().collect()}
    if not counts:
        return Model({})
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))]), F.col("l"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "k"), 11) / float(1 << 53)
    # a long text is cut to windows spread over it; the draw depends on the text alone, so copies are drawn together and one is taken
    size = sample_chars // WINDOWS
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.substring(
        F.col("t"), (F.floor(i * (F.length("t") - size) / (WINDOWS - 1)) + 1).cast("int"), F.lit(size)))
    cut = F.when(F.length("t") <= sample_chars, F.col("t")).otherwise(F.array_join(windows, "\n"))
    drawn = usable.where(draw < rate).select("l", "k", cut.alias("t"), draw.alias("d")).groupBy("l", "k").agg(F.first("t").alias("t"), F.first("d").alias("d"))
    texts_of: dict[str, list[bytes]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["d"], r["k"])):
        folded, _ = symbols(*utf8(pa.array([f"{r['t'].lower()}\n"])))
        texts_of.setdefault(r["l"], []).append(folded.tobytes())
    return Model({k: _shared(v, sample_symbols) for k, v in texts_of.items()})


def _shared(many: list[bytes], most: int) -> bytes:
    """At most ``most`` symbols, equal shares of all texts; what short ones leave goes to the longer."""
    taken = {}
    for done, i in enumerate(sorted(range(len(many)), key=lambda i: len(many[i]))):
        share = (most - sum(map(len, taken.values()))) // (len(many) - done)
        own = many[i]
        if len(own) > share:
            pieces_ = max(1, share // PIECE)
            size = share // pieces_
            own = b"".join(own[at:at + size] for at in ((len(own) - size) * (2 * j + 1) // (2 * pieces_) for j in range(pieces_)))
        taken[i] = own
    return b"".join(taken[i] for i in range(len(many)))


def predict(documents: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``documents``, the predicted language and its score; nothing but the text is looked at."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = documents.drop(out, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = texts(batch.column(text))
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in many])])
            names, scores = [], []
            for a, b in pieces(sizes, 4 << 20):
                n, s = shared.value.predict(many[a:b])
                names += n
                scores.append(s)
            yield add_columns(batch, {out: pa.array(names, pa.string()), score: pa.array(np.concatenate([np.zeros(0), *scores]))})

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType()),
                                             T.StructField(score, T.DoubleType())]))


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``; the model is fitted on the rows that are not held out."""
    held = held_out(F.col(doc_id))
    model = fit(documents.where(~held), doc_id, text, lang)
    own = documents.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return predict(own, model).select("doc_id", "held_out", "lang_pred", "score")
