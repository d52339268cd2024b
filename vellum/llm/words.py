"""Words of whole texts as 64-bit hashes, in numpy.

A word is a maximal run of bytes other than blank and 0x09 to 0x0D, so UTF-8
sequences stay whole.  Equal words have equal hashes; two different ones share
a hash with a chance of 2^-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

from vellum.llm.common import ragged

#: Bytes of a word that are hashed in step with other words; longer ones are hashed on their own.
STEPPED = 48
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = x + M1
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    return x ^ (x >> np.uint64(31))


CODES = mix(np.arange(1, 257, dtype=np.uint64))


class Words:
    """``hashes``, ``starts`` and ``ends`` (bytes of ``data``) of all words; ``first[d]``: first word of text d."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        blank = BLANK[self.data]
        self.starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(size))))
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        length = self.ends - self.starts
        order = np.argsort(-length, kind="stable")
        starts, sorted_length = self.starts[order], length[order]
        h = sorted_length.astype(np.uint64)
        long = int(np.searchsorted(-sorted_length, -STEPPED))  # words longer than STEPPED
        reach = np.searchsorted(-sorted_length, -np.arange(1, STEPPED + 1), side="right")  # words of at least so many bytes
        for step in range(STEPPED):
            n = int(reach[step])
            if n <= long:
                break
            h[long:n] = (h[long:n] ^ CODES[self.data[starts[long:n] + step]]) * M2
            h[long:n] ^= h[long:n] >> np.uint64(29)
        for i in range(long):
            word = self.data[starts[i]:starts[i] + sorted_length[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        out = np.empty_like(h)
        out[order] = mix(h)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spanning_grams(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words at every word, across texts too."""
        g = np.zeros(max(0, len(self.hashes) - k + 1), np.uint64)
        for j in range(k):
            g = (g ^ self.hashes[j:len(g) + j]) * M3
            g ^= g >> np.uint64(32)
        return mix(g)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and how many each text has."""
        n = np.maximum(self.counts() - k + 1, 0)
        return self.spanning_grams(k)[ragged(self.first[:-1], n)], n
