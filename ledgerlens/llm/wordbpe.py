"""BPE with word ends: encoding and decoding with a tokenizer file, by batched merge rounds.

The file's steps are followed: special tokens are found in the raw text; what lies between is normalised (NFC, white space to one blank, lower case),
cut by the file's pattern, and every match is written as characters that stand for its bytes, the last one with the end-of-word suffix.

Merging: the symbols of many different words lie in one flat array. A round finds the rank of every pair by binary search over the sorted pair keys,
takes each word's lowest rank, merges all its places in every word at once (of overlapping ones those that come first) and closes the gaps; only pairs beside a merge are
searched again, and words without a pair leave the array. This equals merging one pair at a time if a merge can only be followed by later
ones, which is checked when the file is read.

Decoding without a decoder step puts a blank between the tokens, as the file asks for.

A null text is empty and gives no ids. Texts of any length are processed whole, words of any length too; repeated texts get equal results; an
empty table gives no rows. Columns of the input that are named like a result are replaced. Nothing is trained and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import add_columns, bounded_batches, texts

_NONE = 1 << 30
_WORDS = 100_000  # words of a long text that are held at a time
#: Lower case of capitals that are newer than Python's character tables (first, last, distance to the small letter); fixed values.
NEWER_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                  (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
#: Letters and digits (first, last) that the pattern module has and the tokenizer library does not have yet; fixed values.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479))


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    other = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(other.get(b, b)) for b in range(256)]


class Encoder:
    """Merges and decodes with one tokenizer file; keeps the ids of recent words."""

    def __init__(self, path: str, kept: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [s["type"] for s in spec["normalizer"]["normalizers"]]
        cut, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], steps, cut["type"], level["type"], spec["decoder"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None) or not cut["invert"] or level["use_regex"]:
            raise ValueError(f"{path} has other steps than these")
        self.kept, self.cut = kept, cut["pattern"]["Regex"]
        self.pattern = regex.compile(self.cut)
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
        without = {p: f"[{p}--[{later}]]" for p in (r"\p{L}", r"\p{N}")}
        self.older = regex.compile("(?V1)" + self.cut.replace(r"\p{L}", without[r"\p{L}"]).replace(r"\p{N}", without[r"\p{N}"]))
        self.capitals = {c: c + d for a, b, d in NEWER_CAPITALS for c in range(a, b + 1)}
        self.newer = regex.compile(f"[{later}{''.join(map(chr, self.capitals))}]")
        replace = spec["normalizer"]["normalizers"][1]
        self.space, self.blank = regex.compile(replace["pattern"]["Regex"]), replace["content"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        shown, end = byte_characters(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.final = np.array([vocab[c + end] for c in shown], np.int64)
        made: dict[int, int] = {}
        keys, new = [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if made.get(left, -1) >= rank or made.get(right, -1) >= rank:
                raise ValueError(f"merge {rank} of {path} comes before its parts")
            made.setdefault(whole, rank)
            keys.append(left << 32 | right)
            new.append(whole)
        if any(made.get(k >> 32, -1) >= r or made.get(k & 0xFFFFFFFF, -1) >= r for r, k in enumerate(keys)):
            raise ValueError(f"{path} has a merge before its parts")
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.new = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(new, np.int64)
        self.known: dict[str, bytes] = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def encode_many(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each word (none of them empty) as little-endian 32-bit integers."""
        if not parts:
            return []
        size = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        last = np.cumsum(size) - 1
        ids, word = self.inner[data], np.repeat(np.arange(len(parts)), size)
        ids[last] = self.final[data[last]]
        rank = np.full(len(ids), _NONE, np.int64)  # of the pair that begins at each symbol
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[last] = _NONE
        done = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.concatenate([first, [len(ids)]]))
            low = np.minimum.reduceat(rank, first)
            low_here = np.repeat(low, count)
            ended = low_here == _NONE
            if ended.any():
                done.append((word[ended], ids[ended]))
                ids, word, rank, low_here = ids[~ended], word[~ended], rank[~ended], low_here[~ended]
                if not len(ids):
                    break
            hit = rank == low_here
            place = np.flatnonzero(hit)
            run = np.concatenate([[True], place[1:] != place[:-1] + 1])  # neighbouring places overlap: every other one of a run
            begin = place[run][np.cumsum(run) - 1]
            place = place[(place - begin) % 2 == 0]
            ids[place] = self.new[rank[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            at = place - np.arange(len(place))  # where the merged symbols are once the gaps are closed
            ids, word, rank = ids[stay], word[stay], rank[stay]
            near = np.concatenate([at, at[at > 0] - 1])
            inside = near < len(ids) - 1
            rank[near[~inside]] = _NONE
            near = near[inside]
            rank[near] = np.where(word[near] == word[near + 1], self._ranks(ids[near], ids[near + 1]), _NONE)
        word, ids = (np.concatenate(x) for x in zip(*done))
        ids = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        upto = (np.cumsum(np.bincount(word, minlength=len(parts))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *upto[:-1]], upto)]

    def normalised(self, text: str) -> str:
        """NFC, white space to one blank, lower case character by character (no rule for final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.newer.search(text):
                text = text.translate(self.capitals)
        return self.space.sub(self.blank, text).lower()

    def _matches(self, text: str) -> Iterator[str]:
        plain = text.isascii() or not self.newer.search(text)
        return (x[0] for x in (self.pattern if plain else self.older).finditer(text))

    def words(self, text: str) -> Iterator[str]:
        """The words of a text and the special tokens in it, in order."""
        at = 0
        for m in self.special_pattern.finditer(text):
            yield from self._matches(self.normalised(text[at:m.start()]))
            yield m[0]
            at = m.end()
        yield from self._matches(self.normalised(text[at:]))

    def _cut(self, text: str) -> list[str]:
        if self.special_pattern.search(text):
            return list(self.words(text))
        text = self.normalised(text)
        return self.pattern.findall(text) if text.isascii() or not self.newer.search(text) else self.older.findall(text)

    def learn(self, words: set[str]) -> None:
        """Makes the ids of these words known; forgets the earlier ones when there are too many."""
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > self.kept:
            own = {s: self.known[s] for s in self.special}
            self.known.clear()
            self.known.update(own)
            missing = [w for w in words if w not in own]
        for w, ids in zip(missing, self.encode_many([w.encode("utf-8", "surrogatepass") for w in missing])):
            self.known[w] = ids

    def encode(self, many: list[str], piece: int = 1 << 21) -> Iterator[Iterator[bytes]]:
        """For each text the ids of its pieces, as little-endian 32-bit integers."""
        i = 0
        while i < len(many):
            if len(many[i]) > piece:
                yield self._encode_long(many[i])
                i += 1
                continue
            j, total = i, 0
            while j < len(many) and total + len(many[j]) <= piece:
                total += len(many[j])
                j += 1
            cut = [self._cut(t) for t in many[i:j]]
            self.learn(set().union(*cut))
            known = self.known.__getitem__
            for words in cut:
                yield iter([b"".join(map(known, words))])
            i = j

    def _encode_long(self, text: str) -> Iterator[bytes]:
        words = self.words(text)
        while some := list(islice(words, _WORDS)):
            self.learn(set(some))
            yield b"".join(map(self.known.__getitem__, some))

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit integers."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def forget(self) -> None:
        self.known = {s: self.known[s] for s in self.special}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``documents`` and ``ids``, the list of token ids of the whole text."""
    bounded_batches(documents.sparkSession)
    kept = documents.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            lists = [b"".join(x) for x in own.encode(texts(batch.column(text)))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(lists), "<u4").astype(np.int32))
            yield add_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets), values)})
        own.forget()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out``, the text that the ids stand for; a null list gives null."""
    kept = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            plain = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield add_columns(batch, {out: pa.array(plain, pa.string())})

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


#: Columns of ``digests``.
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def digests(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``documents`` but ``text``, and the columns of ``DIGESTS``.

    Every text is encoded and its ids are decoded again in pieces; only the length and the digests leave the task.
    """
    bounded_batches(documents.sparkSession)
    own_fields = [f for f in documents.schema if f.name != text and f.name not in DIGESTS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            count, coded, plain = [], [], []
            for parts in own.encode(texts(batch.column(text))):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    if n and ids:
                        b.update(b" ")
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(own.decode(ids).encode("utf-8"))
                count.append(n)
                coded.append(a.hexdigest())
                plain.append(b.hexdigest())
            yield add_columns(batch.select([f.name for f in own_fields]), {
                "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(coded, pa.string()),
                "decoded_sha256": pa.array(plain, pa.string())})
        own.forget()  # the worker lives on; its memory is for the next task

    kept = documents.select(*[f"`{f.name}`" for f in own_fields], text)
    return kept.mapInArrow(run, T.StructType([*own_fields, *DIGESTS]))
