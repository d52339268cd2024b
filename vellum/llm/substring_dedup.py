"""Operator 7, substring deduplication with a compressed FM-index per shard.

A shard holds the fragments around anchors that several documents share.  Its
FM-index keeps the fragments' Burrows-Wheeler transform over words as a wavelet
tree of bit vectors with ranks.  The fragments stream against it: backward
search from every word gives the matching statistic, how many words up to there
match elsewhere, until the threshold is reached; the interval found then holds
all the windows that are equal, and the smallest document among them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ragged, staged
from vellum.llm.passages import (Runs, Shard, cut_runs, first_min, repeated_fragments, shards, spans_by_document, stretches,
                                 union)
from vellum.llm.words import Words

#: Words of an anchor.
GRAM = 5
#: Bytes of fragments in a shard, about; the memory bound of a task.
SHARD_BYTES = 6 << 20


def word_runs(window: int, gram: int = GRAM):
    def runs(texts):
        words = Words(texts)
        n = np.maximum(words.counts() - window + 1, 0)
        if not n.sum():
            return
        g = words.spanning_grams(gram)
        anchor = first_min(g, window - gram + 1)
        doc, at, size = cut_runs(anchor, words.first, n)
        yield Runs(doc, g[anchor[at]], at - words.first[doc], size, words.starts[at],
                   words.ends[at + size + window - 2], words.data.tobytes())
    return runs


class Bits:
    """Bit vector with constant-time ranks: 64 bits and one running count for them."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[:len(raw)] = raw
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletTree:
    """Ranks of symbols, level by level from their highest bit (all nodes of a level in one bit vector)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones), int((~ones).sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where [low, high) goes if only ``symbol`` is followed: the differences are its ranks."""
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return low, high


class FMIndex:
    """Backward search for strings of up to ``depth`` symbols in sequences of symbols.

    Suffixes are sorted by their first ``depth`` symbols, all that such searches
    tell apart.  Symbol 0 stands behind every sequence.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        top = int(symbols.max()) + 1
        bits = max(1, int(top - 1).bit_length())
        order = self._sorted(symbols, bits, depth)
        self.order = order
        self.size = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top))))
        self.tree = WaveletTree(symbols[order - 1], bits)
        zero = np.zeros(top, np.int64)
        self.base = self.tree.ranks(np.arange(top), zero, zero)[0]  # where the ranks of a symbol begin

    @staticmethod
    def _sorted(symbols: np.ndarray, bits: int, depth: int) -> np.ndarray:
        """Places in the order of their first ``depth`` symbols, by doubling; settled places drop out."""
        n, reach = len(symbols), min(62 // bits, depth)
        padded = np.concatenate((symbols, np.zeros(reach, np.int64)))
        key = np.zeros(n, np.int64)
        for j in range(reach):
            key = key << bits | padded[j:n + j]
        order = np.argsort(key)
        rank = np.full(n + depth, -1, np.int64)  # place of the first with the same symbols
        at, key = np.arange(n), key[order]
        while True:
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(key)))
            rank[order[at]] = np.repeat(at[begin], size)
            at = at[np.repeat(size > 1, size)]
            step = min(reach, depth - reach)
            if step <= 0 or not len(at):
                return order
            some = order[at]
            key = rank[some] * (n + 1) + rank[some + step] + 1
            by = np.argsort(key)
            order[at], key = some[by], key[by]
            reach += step

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of ``symbol`` before the strings of the intervals."""
        a, b = self.tree.ranks(symbol, low, high)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift

    def left_extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of every symbol but 0 that stands before the strings of the intervals."""
        symbol = np.zeros(len(low), np.int64)
        for level, bits, zeros in self.tree.levels:
            a, b = bits.rank(low), bits.rank(high)
            left, right = (high - low) > (b - a), b > a
            low, high = np.concatenate(((low - a)[left], (zeros + a)[right])), np.concatenate(((high - b)[left], (zeros + b)[right]))
            symbol = np.concatenate((symbol[left], symbol[right] | 1 << level))
        some = symbol > 0
        symbol = symbol[some]
        shift = self.first[symbol] - self.base[symbol]
        return low[some] + shift, high[some] + shift


class IndexedFragments:
    """The distinct fragments of a shard behind an FM-index, with their smallest ids."""

    def __init__(self, words: Words, ids: np.ndarray, window: int):
        n = words.counts()
        self.alphabet, own = np.unique(words.hashes, return_inverse=True)
        ends = np.cumsum(n + 1)
        symbols = np.zeros(int(ends[-1]), np.int64)
        symbols[ragged(ends - n - 1, n)] = own + 1
        self.index = FMIndex(symbols, window)
        self.ids = np.append(np.repeat(ids, n + 1)[self.index.order], np.iinfo(np.int64).max)

    def smallest(self, words: Words, end: np.ndarray, window: int) -> np.ndarray:
        """Smallest id of a fragment with the window that ends at word ``end``; none: the largest number.

        """
        at = np.minimum(np.searchsorted(self.alphabet, words.hashes), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == words.hashes, at + 1, 0)
        out = np.full(len(end), np.iinfo(np.int64).max)
        live, place = np.arange(len(end)), end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.index.size)
        for _ in range(window):  # the matching statistics of all words grow in step
            s = symbol[place]
            low, high = self.index.extend(s, low, high)
            some = (high > low) & (s > 0)
            live, low, high, place = live[some], low[some], high[some], place[some] - 1
        if len(live):
            start, back = np.unique(low, return_inverse=True)
            stop = np.zeros(len(start), np.int64)
            stop[back] = high
            out[live] = np.minimum.reduceat(self.ids, np.column_stack((start, stop)).ravel())[::2][back]
        return out


def covered(shard: Shard, earlier: list[IndexedFragments], window: int) -> tuple[pa.RecordBatch, IndexedFragments]:
    """Stretches of the shard's fragments that occur in smaller documents, and the shard's index."""
    texts, own = shard.texts, shard.text
    ids = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(ids, own, shard.id)
    windows = np.zeros(len(texts), np.int64)
    windows[own] = shard.windows
    words = Words([t.decode() for t in texts])
    index = IndexedFragments(words, ids, window)
    end = ragged(words.first[:-1] + window - 1, windows)
    best = np.minimum.reduce([x.smallest(words, end, window) for x in (*earlier, index)])
    begin = np.cumsum(windows) - windows
    rows = ragged(begin[own], shard.windows)  # windows of every fragment, copies included
    of = np.repeat(np.arange(len(own)), shard.windows)
    hit = np.flatnonzero(best[rows] < shard.id[of])
    return stretches(shard, of[hit], rows[hit] - begin[own[of[hit]]], window), index


def remove_repeated_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                            keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` columns, ``text_col``, ``n_words``, ``n_removed``, ``kept``, ``spans`` of every row.

    A word is removed if a window of ``window`` words that covers it also starts
    in a document with a smaller id; windows are judged on the input.  ``kept``
    joins the other words by blanks (a null text has no words), ``spans`` are the
    removed stretches of words.  Rows with a null id are neither judged nor held
    against others.  Rows that repeat an id and a text are one document; repeated
    ids don't make each other smaller.  An empty table gives an empty result;
    texts are always taken whole, other columns are not read.

    Shards have about SHARD_BYTES of fragments.  An anchor that fills several is
    searched shard after shard, each against those before it: documents arrive
    in order of their ids, so no later shard matters.
    """
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("keep"))
    fragments = repeated_fragments(rows.select("id", "text"), word_runs(window), across=True)

    def judge(batches):
        earlier: list[IndexedFragments] = []  # shards of the anchor that goes on
        for shard in shards(batches, SHARD_BYTES, split=True):
            if not shard.goes_on:
                earlier = []
            batch, index = covered(shard, earlier, window)
            earlier = [*earlier, index] if shard.key[-1] == shard.key[0] else [index]
            yield batch

    spans = staged(fragments.repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(
        judge, "id long, start long, stop long"), "spans")
    joined = rows.join(spans_by_document(spans), "id", "left").select("id", "text", "keep", "spans")

    def apply(batches):
        for b in chunks(batches):
            n, gone, kept, cut = [], [], [], []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                words = (text or "").encode().split()
                out = union(spans or [])
                left = words
                if out:
                    stay = np.ones(len(words), bool)
                    for a, e in out:
                        stay[a:e] = False
                    left = list(itertools.compress(words, stay.tolist()))
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                cut.append([{"start": a, "stop": e} for a, e in out])
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["keep"], b["text"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["id", "keep", "text", "n_words", "n_removed", "kept", "spans"])

    keep_type = rows.schema["keep"].dataType.simpleString()
    return joined.mapInArrow(apply, f"id long, keep {keep_type}, text string, n_words long, n_removed long, kept string, "
                                    "spans array<struct<start:long,stop:long>>").select(
        F.col("id").alias(id_col), *[F.col(f"keep.{c}").alias(c) for c in keep], F.col("text").alias(text_col),
        "n_words", "n_removed", "kept", "spans")
