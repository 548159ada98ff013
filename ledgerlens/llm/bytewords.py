"""Words of a block of UTF-8 texts as numbers, worked out on whole byte arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), 2 * _SPAN)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), 2 * _SPAN)

#: Bytes of words: digits, letters of either case and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words(NamedTuple):
    """Start and end byte, text number and 64-bit hash of every word, in order."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> Words:
    """Longest runs of word bytes inside each text, lower-cased in ASCII."""
    inside = word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = False
    after[filled[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1, hashes(LOWER[data], start, end))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice, by running sums of byte times power; equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SPAN, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a >= len(_UP):  # a single slice of a million bytes or more
            out[i] = _long(data[a:b])
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _UP[: b - a], out=sums[1:])
            s = start[i:j] - a
            h = (sums[end[i:j] - a] - sums[s]) * _DOWN[s]
            out[i:j] = h
        i = j
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _long(data: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    for k in range(0, len(data), _SPAN):
        part = data[k:k + _SPAN].astype(np.uint64) + np.uint64(1)
        total += shift * int((part * _UP[: len(part)]).sum())
        shift = shift * pow(int(_BASE), _SPAN, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


class Lookup:
    """Finds 64-bit hashes in a sorted set; a bit table turns most of the others away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, -1 if it is none."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == hashes[maybe], at, -1)
        return out
