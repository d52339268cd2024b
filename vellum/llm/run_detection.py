"""Operator 13, periodic runs of words by branching tandem repeats on an enhanced suffix array.

The words of a chunk of texts are numbered text by text, and a sentinel of its
own stands behind every text, so no suffix matches beyond its text.  Suffixes
are sorted by doubling; the ranks of every doubling stay and answer how far two
places agree.  Of each interval of suffixes with common prefix d, the suffixes
outside its largest child look up whether the places d before and behind are in
the interval too: if so and the next words differ, two equal halves of d words
stand there that can't be moved to the right.  Rotated to the left as far as
they go, such squares are the runs.  Intervals come as bounds out of arrays
(smaller values before and behind each prefix length); no tree is built.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ragged

#: A run has at least so many periods, and at least so many words.
EXPONENT, LEAST_WORDS = 4, 6


class EnhancedSuffixArray:
    """Suffixes of numbered words whose last one occurs once: order, ranks of every doubling, common prefixes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols = symbols
        size = np.bincount(symbols)
        self.order = np.argsort(symbols, kind="stable")
        #: levels[k][i]: place of the first suffix with the same 2^k words as suffix i
        self.levels = [(np.cumsum(size) - size)[symbols]]
        at = np.flatnonzero((size > 1)[symbols[self.order]])
        while len(at):
            rank, some = self.levels[-1], self.order[at]
            # words that occur twice hold no sentinel, so a word follows them
            key = rank[some] * (n + 1) + rank[some + (1 << len(self.levels) - 1)]
            by = np.argsort(key, kind="stable")
            self.order[at], key = some[by], key[by]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(new, len(key)))
            rank = rank.copy()
            rank[self.order[at]] = np.repeat(at[new], size)
            self.levels.append(rank)
            at = at[np.repeat(size > 1, size)]
        self.place = self.levels[-1]  # inverse of order
        self.prefix = np.zeros(n + 1, np.int64)  # of the suffixes before and behind each border of order
        border = 1 + np.flatnonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]])
        self.prefix[border] = self.agree(self.order[border - 1], self.order[border])

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i and j on that are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]) * (1 << k)
        return out

    def agree_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words up to i and j (i < j) that are equal."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            out += ((a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])) * (1 << k)
        return out

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Borders with a common prefix; first place and place behind the last of the interval of each."""
        border = np.flatnonzero(self.prefix)
        if not len(border):
            return (border,) * 3
        value = self.prefix[border]
        gap = np.flatnonzero(np.diff(border) > 1)
        longest = int(np.diff(np.concatenate(([0], gap + 1, [len(border)]))).max())
        low_of = [self.prefix]  # low_of[k][i]: smallest of the 2^k values from i on
        while 2 << len(low_of) - 1 <= longest:
            half = 1 << len(low_of) - 1
            low_of.append(np.minimum(low_of[-1][:-half], low_of[-1][half:]))
        left, right = border.copy(), border + 1
        for k in range(len(low_of) - 1, -1, -1):
            low, step = low_of[k], 1 << k
            a = left - step
            left = np.where((a >= 0) & (low[np.maximum(a, 0)] >= value), a, left)
            right = np.where((right < len(low)) & (low[np.minimum(right, len(low) - 1)] >= value), right + step, right)
        return border, left - 1, right

    def squares(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and half of the squares that can't be moved to the right, of intervals with ``least`` suffixes or more."""
        border, first, stop = self.intervals()
        some = stop - first >= least
        border, first, stop = border[some], first[some], stop[some]
        if not len(border):
            return border, border
        depth = self.prefix[border]
        by = np.lexsort((border, depth, first))
        border, first, stop, depth = border[by], first[by], stop[by], depth[by]
        head = np.append(True, (first[1:] != first[:-1]) | (depth[1:] != depth[:-1]))
        lead = np.flatnonzero(head)
        tail = np.append(lead[1:], len(border)) - 1
        # children: before every border, and behind the last border of an interval
        group = np.cumsum(head) - 1
        at = np.arange(len(border)) + group
        end = tail + np.arange(len(lead))
        begin, behind = np.empty(len(border) + len(lead), np.int64), np.empty(len(border) + len(lead), np.int64)
        begin[at] = np.where(head, first, np.append(0, border[:-1]))
        behind[at] = border
        begin[end + 1], behind[end + 1] = border[tail], stop[tail]
        size = behind - begin
        opens = lead + np.arange(len(lead))
        owner = np.repeat(np.arange(len(lead)), np.diff(np.append(opens, len(size))))
        largest = np.flatnonzero(size == np.maximum.reduceat(size, opens)[owner])
        largest = largest[np.unique(owner[largest], return_index=True)[1]]
        smaller = np.ones(len(size), bool)
        smaller[largest] = False
        begin, size, owner = begin[smaller], size[smaller], np.repeat(owner[smaller], size[smaller])
        i = self.order[ragged(begin, size)]
        d, a, b = depth[lead][owner], first[lead][owner], stop[lead][owner]

        def member(places):
            return (self.place[places] >= a) & (self.place[places] < b)

        ahead = member(i + d)
        ahead[ahead] = self.symbols[(i + d)[ahead]] != self.symbols[(i + 2 * d)[ahead]]
        back = (i >= d) & member(np.maximum(i - d, 0))
        back[back] = self.symbols[i[back]] != self.symbols[(i + d)[back]]
        return np.concatenate((i[ahead], (i - d)[back])), np.concatenate((d[ahead], d[back]))


def maximal_runs(symbols: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS):
    """Start, length and smallest period of the runs of numbered words, in order of start, then period."""
    index = EnhancedSuffixArray(symbols)
    # the last `exponent` halves of a run begin suffixes that share one period, so its interval has as many
    start, period = index.squares(max(2, exponent))
    turns = index.agree_before(start, start + period)
    start, length = start - turns, turns + 2 * period
    some = length >= np.maximum(least, exponent * period)
    start, length, period = start[some], length[some], period[some]
    by = np.lexsort((period, length, start))  # multiples of the smallest period give the same run
    start, length, period = start[by], length[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def numbered(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, each text with its own and a sentinel behind; where each text begins."""
    parts, top = [], 0
    for words in texts:
        known = dict.fromkeys(words)
        known = dict(zip(known, range(top, top + len(known))))
        top += len(known) + 1
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([top - 1]))
    size = np.fromiter((len(p) for p in parts), np.int64, len(parts)).reshape(-1, 2).sum(axis=1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(size)))


def rewritten(words: list, doc_id: int | None) -> list:
    """Words of a text of which a tail may repeat its beginning: where the tail begins, and its period, follow the id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False,
                  exponent: int = EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """``id_col``, ``n_words``, ``runs``, ``kept`` (binary) of every row.

    A run is a stretch of words (maximal runs of bytes other than blank and 0x09 to
    0x0D) of one whole text with smallest period q: words q apart are equal, no
    neighbouring word goes on with it, and it has at least ``exponent`` * q and
    ``least`` words.  ``runs`` are in order of start, then period; ``kept`` has the
    words that no run holds behind its first q words, joined by one blank.
    ``planted`` rewrites a tenth of the texts first (``rewritten``).

    Null, empty and blank texts have no words, no runs and nothing kept.  A row with
    a null id is judged like any other and never rewritten; repeated rows are judged
    one by one.  An empty table gives an empty result; other columns are not read.
    Nothing is shuffled: a task holds the index of one chunk of texts, or of one
    longer text (about 300 bytes for each of its words).
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def detect(batches):
        for b in chunks(batches):
            ids = b["id"].to_pylist()
            texts = [(t or "").encode().split() for t in b["text"].to_pylist()]  # bytes: blank and 0x09 to 0x0D
            if planted:
                texts = [rewritten(w, i) for w, i in zip(texts, ids)]
            symbols, first = numbered(texts)
            start, length, period = maximal_runs(symbols, exponent, least)
            cuts = np.searchsorted(start, first)
            found, kept = [], []
            for d, words in enumerate(texts):
                some = range(cuts[d], cuts[d + 1])
                found.append([{"start": int(start[r] - first[d]), "length": int(length[r]), "period": int(period[r])} for r in some])
                if some:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in found[-1]:
                        gone[r["start"] + r["period"]] += 1
                        gone[r["start"] + r["length"]] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([len(w) for w in texts], pa.int64()),
                 pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                 pa.array(kept, pa.binary())], names=["id", "n_words", "runs", "kept"])

    return rows.mapInArrow(detect, f"id long, n_words long, runs {RUNS}, kept binary").withColumnRenamed("id", id_col)


def strongest(runs: F.Column) -> F.Column:
    """The run with the greatest exact length / period; ties fall to the smallest start, then period.

    ``runs`` are in order of start, then period, so the first of equals stays.
    Products are decimals: lengths and periods have at most 63 bits.
    """
    wide = lambda x: x.cast("decimal(19,0)")
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(
        wide(r["length"]) * wide(best["period"]) > wide(best["length"]) * wide(r["period"]), r).otherwise(best))
