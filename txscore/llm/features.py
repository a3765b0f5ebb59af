"""Hashed features of whole texts for the linear models."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from txscore.llm.decontaminate import words_of

_U = np.uint64
_LIMIT = 1 << 19


class _Cache(dict):
    """Values of words, made on demand; emptied when there are too many words."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) >= _LIMIT:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class SkipGrams:
    """Word 1-grams, 2-grams and skip-grams over one word, hashed to `bits` bits; each counts once in a text."""

    def __init__(self, bits: int):
        self.shift, self.words = _U(64 - bits), _Cache(xxhash.xxh3_64_intdigest)

    def all(self, text: bytes | None) -> np.ndarray:
        """The hashes in text order by kind, repeats included."""
        found = words_of(text)
        h = np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))
        with np.errstate(over="ignore"):
            parts = [h, h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:], h[:-2] * _U(0xC2B2AE3D27D4EB4F) + h[2:] * _U(3)]
            return (_mix(np.concatenate(parts)) >> self.shift).astype(np.int64)


_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class Surface:
    """Shares of hashed words and word shapes (runs of capitals, small letters, digits and marks), and buckets of simple measures."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = _Cache(lambda w: (xxhash.xxh3_64_intdigest(w.lower(), 1) >> 64 - bits, xxhash.xxh3_64_intdigest(_RUNS.sub(rb"\1", w.translate(_SHAPE)), 2) >> 64 - bits))

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values."""
        text = text or b""
        found = text.split()
        n = len(found)
        pairs = np.array(list(map(self.words.__getitem__, found)), np.int64).reshape(n, 2)
        word, times = np.unique(pairs[:, 0], return_counts=True)
        shape, often = np.unique(pairs[:, 1], return_counts=True)
        lines = [x for x in text.split(b"\n") if x.strip()]
        measures = [
            (b"size", min(int(np.log2(n + 1)), 15)),
            (b"types", int(10 * len(word) / n * min(1.0, n**0.5 / 20)) if n else -1),
            (b"same", int(10 * (times.max() / n)) if n else -1),
            (b"lines", int(10 * len(set(lines)) / len(lines)) if lines else -1),
            (b"width", min(int(np.log2(1 + n / len(lines))), 10) if lines else -1),
        ]
        own = np.array([xxhash.xxh3_64_intdigest(k + b"=%d" % v, 3) >> 64 - self.bits for k, v in measures], np.int64)
        index = np.concatenate([word, shape, own])
        value = np.concatenate([times / max(n, 1), 4 * often / max(n, 1), np.full(len(own), 0.5)])
        return index, value
