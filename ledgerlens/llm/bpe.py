"""Byte-level BPE encoding and decoding with a rank file.

Texts are cut by a pattern; each match is merged by itself. Merging keeps the parts of a pre-token as a linked list and all
mergeable pairs in a rank queue: one bucket per merge rank with the list positions of its pairs, and a bitmap of three levels over the
ranks, so that find-first-set names the lowest rank with an entry. A popped position is stale, and skipped, if its pair has
changed since. A merge costs the same however long the pre-token is.

Two forms of the queue give the same result. ``encode_one`` takes one pre-token, for long ones. ``encode_many`` puts all the
different short pre-tokens of a block on one list with breaks between them and pops a whole bucket at once: merges in different
pre-tokens do not touch one another, and of one pre-token only the leftmost pair of the bucket is merged per turn, since the merge may
bring a lower rank.

A null text is empty and gives no ids. Texts of any length are processed whole, a piece of their pre-tokens at a time. Ranks are
never trained or changed; ids without an entry raise an error when decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import add_columns, bounded_batches, texts

_NONE = 1 << 30


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks of {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


class RankQueue:
    """Buckets by rank under a bitmap of three levels, 64 bits a word."""

    def __init__(self, ranks: int):
        self.words = [0] * (-(-ranks // 64))
        self.groups = [0] * (-(-len(self.words) // 64))
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            w, g = rank >> 6, rank >> 12
            self.words[w] |= 1 << (rank & 63)
            self.groups[g] |= 1 << (w & 63)
            self.top |= 1 << g
        else:
            bucket.append(entry)

    def lowest(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        if not self.top:
            return -1
        g = (self.top & -self.top).bit_length() - 1
        x = self.groups[g]
        w = (g << 6) + (x & -x).bit_length() - 1
        x = self.words[w]
        return (w << 6) + (x & -x).bit_length() - 1

    def take(self, rank: int) -> list:
        """Removes and returns the bucket."""
        w, g = rank >> 6, rank >> 12
        self.words[w] &= ~(1 << (rank & 63))
        if not self.words[w]:
            self.groups[g] &= ~(1 << (w & 63))
            if not self.groups[g]:
                self.top &= ~(1 << g)
        return self.buckets.pop(rank)


class Encoder:
    """Merges and decodes with one vocabulary; keeps the ids of recent pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, kept: int = 250_000, long: int = 512):
        self.tokens, self.kept, self.long = tokens, kept, long
        self.pattern = regex.compile(pattern)
        rank = {t: i for i, t in enumerate(tokens)}
        self.rank = rank
        self.bytes = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        pairs = [(rank[t[:k]] << 32 | rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t))
                 if t[:k] in rank and t[k:] in rank]
        pairs.sort()
        self.keys = np.array([p for p, _ in pairs], np.int64)
        self.values = np.array([v for _, v in pairs], np.int64)
        self.pair = dict(pairs)
        self.known: dict[str, bytes] = {}

    def encode_one(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        ids = self.bytes[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair, queue = self.pair, RankQueue(len(self.tokens))
        for i in range(n - 1):
            r = pair.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                queue.push(r, i)
        while (r := queue.lowest()) >= 0:
            bucket = sorted(queue.take(r))
            for k, i in enumerate(bucket):
                j = after[i]
                if ids[i] < 0 or j >= n or pair.get(ids[i] << 32 | ids[j]) != r:
                    continue  # stale
                ids[i], ids[j] = r, -1
                after[i] = e = after[j]
                if e < n:
                    before[e] = i
                    x = pair.get(r << 32 | ids[e])
                    if x is not None:
                        queue.push(x, i)
                b = before[i]
                if b >= 0:
                    x = pair.get(ids[b] << 32 | r)
                    if x is not None:
                        queue.push(x, b)
                low = queue.lowest()
                if 0 <= low <= r:  # the merge brought a rank that comes first: the rest of the bucket waits
                    for other in bucket[k + 1:]:
                        queue.push(r, other)
                    break
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def encode_many(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each of many pre-tokens, as little-endian 32-bit integers."""
        size = np.array([len(p) + 1 for p in parts], np.int64)
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ids = self.bytes[data]
        ends = np.cumsum(size) - 1
        ids[ends] = -1  # breaks
        owner = np.repeat(np.arange(len(parts)), size)
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, _NONE, np.int64)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        queue = RankQueue(len(self.tokens))
        self._push(queue, rank, np.flatnonzero(rank != _NONE))
        while (r := queue.lowest()) >= 0:
            bucket = queue.take(r)
            places = np.concatenate(bucket) if len(bucket) > 1 else bucket[0]
            places = places[rank[places] == r]  # the others are stale
            if not len(places):
                continue
            if len(bucket) > 1:
                places = np.unique(places)
            new = np.ones(len(places), bool)
            new[1:] = owner[places[1:]] != owner[places[:-1]]
            if not new.all():
                queue.push(r, places[~new])
                places = places[new]
            right = after[places]
            ids[places], ids[right] = r, -2
            follow = after[right]
            after[places] = follow
            before[follow] = places
            rank[right] = _NONE
            rank[places] = self._ranks(ids[places], ids[follow])
            left = before[places]
            has = left >= 0
            left = left[has]
            rank[left] = self._ranks(ids[left], ids[places[has]])
            changed = np.concatenate([places, left])
            self._push(queue, rank, changed[rank[changed] != _NONE])
        keep = ids >= 0
        out = ids[keep].astype("<u4").tobytes()
        upto = (np.cumsum(np.bincount(owner[keep], minlength=len(parts))) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *upto[:-1]], upto)]

    @staticmethod
    def _push(queue: RankQueue, rank: np.ndarray, places: np.ndarray) -> None:
        if len(places):
            places = places[np.argsort(rank[places], kind="stable")]
            ranks = rank[places]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(places)]
            for r, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:]):
                queue.push(r, places[a:b])

    def learn(self, words: set[str]) -> None:
        """Makes the ids of these pre-tokens known; forgets the earlier ones when there are too many."""
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > self.kept:
            self.known.clear()
            missing = list(words)
        coded = [w.encode("utf-8", "surrogatepass") for w in missing]
        short = [i for i, c in enumerate(coded) if len(c) <= self.long]
        if short:
            for i, ids in zip(short, self.encode_many([coded[i] for i in short])):
                self.known[missing[i]] = ids
        for w, c in zip(missing, coded):
            if len(c) > self.long:
                self.known[w] = np.array(self.encode_one(c), "<u4").tobytes()

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
            cut = [self.pattern.findall(t) for t in many[i:j]]
            self.learn(set().union(*cut))
            known = self.known.__getitem__
            for words in cut:
                yield iter([b"".join(map(known, words))])
            i = j

    def _encode_long(self, text: str) -> Iterator[bytes]:
        matches = (m[0] for m in self.pattern.finditer(text))
        while words := list(islice(matches, 100_000)):
            self.learn(set(words))
            yield b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and rank file."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[key]


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``documents`` and ``ids``, the list of token ids of the whole text."""
    bounded_batches(documents.sparkSession)
    kept = documents.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            lists = [b"".join(x) for x in own.encode(texts(batch.column(text)))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(lists), "<u4").astype(np.int32))
            yield add_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets), values)})
        own.known.clear()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``out``, the bytes that the ids stand for; a null list gives null."""
    kept = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            yield add_columns(batch, {out: pa.array([None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in lists],
                                                    pa.binary())})

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


#: Columns of ``digests``.
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def digests(documents: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``documents`` but ``text``, and the columns of ``DIGESTS``.

    Every text is encoded and its ids are decoded again in pieces; only the length and the digests leave the task.
    """
    bounded_batches(documents.sparkSession)
    own_fields = [f for f in documents.schema if f.name != text and f.name not in DIGESTS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            count, coded, plain = [], [], []
            for parts in own.encode(texts(batch.column(text))):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(own.decode(ids))
                count.append(n)
                coded.append(a.hexdigest())
                plain.append(b.hexdigest())
            yield add_columns(batch.select([f.name for f in own_fields]), {
                "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(coded, pa.string()),
                "decoded_sha256": pa.array(plain, pa.string())})
        own.known.clear()  # the worker lives on; its memory is for the next task

    kept = documents.select(*[f"`{f.name}`" for f in own_fields], text)
    return kept.mapInArrow(run, T.StructType([*own_fields, *DIGESTS]))
