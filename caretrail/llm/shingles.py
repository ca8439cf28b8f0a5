"""Hashes of word shingles, computed for whole Arrow batches with numpy.

A word's hash takes in its length and eight bytes at a time, each step through a 64-bit finaliser, so words differ in hash
but by chance (no algebra makes some collide, as with polynomials); words of more than ``LONG`` bytes go through blake2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
CHUNK = 2_000_000  # bytes of text hashed at once, if no single text is longer
LONG = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word ``data[start:end]`` of an array of bytes."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    length = (ends - starts).astype(np.uint64)
    out = mixed(length + _BASE)
    for n in range(0, min(LONG, int(length.max(initial=0))), 8):
        live = np.flatnonzero(length > n)
        part = eight[starts[live] + n]
        bytes_left = np.minimum(length[live] - np.uint64(n), np.uint64(8))
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * bytes_left)
        out[live] = mixed((out[live] ^ (part & mask)) + _BASE)
    for i in np.flatnonzero(length > LONG):
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


class Shingler:
    def sets(self, texts: list[str | None]):
        """The sorted distinct shingle hashes of each text."""
        chunk, size = [], 0
        for t in texts:
            data = (t or "").encode()
            if chunk and size + len(data) > CHUNK:
                yield from self._chunk(chunk)
                chunk, size = [], 0
            chunk.append(data)
            size += len(data) + 1
        if chunk:
            yield from self._chunk(chunk)

    def _chunk(self, chunk: list[bytes]):
        data = _LOWER[np.frombuffer(b" ".join(chunk) + b" ", np.uint8)]
        edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[data]].astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        words = word_hashes(data, starts, ends)
        limits = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in chunk]))
        many = max(0, len(words) - SHINGLE + 1)
        shingles = np.zeros(many, np.uint64)
        for j in range(SHINGLE):
            shingles = mixed(shingles + words[j:j + many] + np.uint64(j + 1))
        low = 0
        for high in limits.tolist():
            if high - low >= SHINGLE:
                yield np.unique(shingles[low:high - SHINGLE + 1])
            elif high > low:
                whole = np.zeros(1, np.uint64)
                for j in range(low, high):
                    whole = mixed(whole + words[j:j + 1] + np.uint64(high - low + 100 * (j - low + 1)))
                yield whole
            else:
                yield np.zeros(0, np.uint64)
            low = high
