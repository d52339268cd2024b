"""Operator 4, exact repeats of many bytes by threshold-bounded interval expansion.

A shard holds the distinct fragments around anchors that occur several times;
their copies are counted before and get the stretches that were found afterwards.
Breadth first, the intervals of the shard's Burrows-Wheeler transform are extended
backwards by one byte: an interval of strings of length l + 1 ends where the
common prefix with the next suffix is l, if no shorter string has ended there.
The common prefixes so come out by increasing value, and the search stops at the
length asked for: suffixes between which nothing has ended share at least that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ragged, staged
from vellum.llm.passages import BLOCK, Runs, cut_runs, first_min, repeated_fragments, spans_by_document, union
from vellum.llm.substring_dedup import FMIndex
from vellum.llm.words import CODES, M2, M3

#: Bytes of an anchor, a power of two.
GRAM = 64
#: Bytes of distinct fragments in a shard, about; the memory bound of a task.
SHARD_BYTES = 3 << 20


def doubled(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours as one."""
    h = left * M2
    h ^= right
    h *= M3
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes at every place that has so many behind it."""
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    for s in range(0, len(out), BLOCK):
        part = _gram_hashes(data[s:s + BLOCK + length - 1], length)
        out[s:s + len(part)] = part
    return out


def _gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    g, reach, out, have = CODES[data], 1, None, 0
    while True:
        if length & reach:
            out = g if out is None else doubled(out[:len(g) - have], g[have:])
            have += reach
        if have == length:
            return out[:len(data) - length + 1]
        g = doubled(g[:-reach], g[reach:])
        reach *= 2


def byte_runs(window: int, gram: int = GRAM):
    def runs(texts):
        raw = [(t or "").encode() for t in texts]
        data = b"".join(raw)
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        count = np.maximum(n - window + 1, 0)
        if not count.any():
            return
        first = np.cumsum(n) - n
        g = gram_hashes(np.frombuffer(data, np.uint8), gram)
        anchor = first_min(g, window - gram + 1)
        doc, at, size = cut_runs(anchor, first, count)
        yield Runs(doc, g[anchor[at]], at - first[doc], size, at, at + size - 1 + window, data)
    return runs


def ends_of_prefixes(index: FMIndex, length: int) -> np.ndarray:
    """Places (0 to n) between suffixes whose common prefix is shorter than ``length``.

    Strings with the separator are left out: a suffix that has one within
    ``length`` may stay joined to what follows it.
    """
    ended = np.zeros(index.size + 1, bool)
    ended[[0, index.size]] = True
    low, high = np.array([0]), np.array([index.size])
    for _ in range(length):
        low, high = index.left_extensions(low, high)
        new = ~ended[high]
        low, high = low[new], high[new]
        ended[high] = True
        if not len(low):
            break
    return ended


def repeated(data: np.ndarray, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Of the windows of stretches of ``data``, which occur at least twice; stretch by stretch."""
    size = windows + window - 1
    if not len(start):
        return np.zeros(0, bool)
    alphabet = np.zeros(256, np.int64)
    body = data[ragged(start, size)]
    present = np.unique(body)
    alphabet[present] = np.arange(1, len(present) + 1)
    begin = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    symbols[ragged(begin, size)] = alphabet[body]
    index = FMIndex(symbols, window)
    group = np.cumsum(ends_of_prefixes(index, window)[:-1])
    of = np.empty(index.size, np.int64)
    of[index.order] = group
    of = of[ragged(begin, windows)]
    return np.bincount(of, minlength=int(group[-1]) + 1)[of] > 1


def judged(keys: np.ndarray, several: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Of distinct fragments: those with windows that occur somewhere else, their first and their last such window.

    ``several``: whether the whole fragment occurs at several places.
    """
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n)
    windows = size - window + 1
    first = np.cumsum(size) - size
    low, high = np.where(several, 0, windows), np.where(several, windows - 1, -1)
    group = np.unique(keys, return_inverse=True)[1]
    # windows whose hash occurs in several fragments of an anchor go on to the index
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    at = ragged(first[some], windows[some])
    if len(at):
        h = gram_hashes(data, window)[at]
        order = np.argsort(h, kind="stable")
        equal = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        part, docs = at[again], np.repeat(some, windows[some])[again]
        if len(part):
            new = np.flatnonzero(np.append(True, (part[1:] != part[:-1] + 1) | (docs[1:] != docs[:-1])))
            found = repeated(data, part[new], np.diff(np.append(new, len(part))), window)
            docs, offset = docs[found], (part - first[docs])[found]
            np.minimum.at(low, docs, offset)
            np.maximum.at(high, docs, offset)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit]


def content_shards(batches, limit: int):
    """Distinct fragments in order of their keys, in lists of about ``limit`` bytes cut between keys."""
    held, size, before = ([], [], [], []), 0, None
    for b in batches:
        columns = b["key"].to_pylist(), b["digest"].to_pylist(), b["several"].to_pylist(), b["data"].to_pylist()
        for row in zip(*columns):
            if size >= limit and row[0] != before:
                yield held
                held, size = ([], [], [], []), 0
            for column, value in zip(held, row):
                column.append(value)
            before, size = row[0], size + len(row[3])
    if held[0]:
        yield held


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``kept`` (binary), ``spans`` of every row.

    A byte of a text's UTF-8 form is removed if a string of ``length`` bytes that
    covers it also starts anywhere else, in the same text or another; strings are
    judged on the input.  ``spans`` are the maximal removed stretches.  A null text
    has no bytes.  Rows with a null id are neither judged nor held against others;
    rows that repeat an id and a text are one document.  An empty table gives an
    empty result; texts are always taken whole, other columns are not read.

    A shard has about SHARD_BYTES of distinct fragments, unless one anchor alone
    has more of them.  Copies never reach a shard: they are counted by aggregation,
    and a join deals what was found to their places, a hot content to several tasks.
    """
    if length <= GRAM:
        raise ValueError(f"strings have more than {GRAM} bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fragments = staged(repeated_fragments(rows, byte_runs(length), across=False).select(
        "key", "id", "start", "data", F.unhex(F.sha2("data", 256)).alias("digest")), "fragments")
    # a row that is repeated is the same place
    contents = fragments.groupBy("key", "digest", "data").agg(
        ((F.min("id") < F.max("id")) | (F.min("start") < F.max("start"))).alias("several"))

    def judge(batches):
        for keys, digests, several, texts in content_shards(batches, SHARD_BYTES):
            hit, low, high = judged(np.array(keys, np.int64), np.array(several, bool), texts, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in hit], pa.int64()), pa.array([digests[i] for i in hit], pa.binary()),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["key", "digest", "low", "high"])

    found = staged(contents.repartition("key").sortWithinPartitions("key").mapInArrow(
        judge, "key long, digest binary, low long, high long"), "found")
    # of a content with many places, the join's skewed partition is split
    spans = fragments.select("key", "digest", "id", "start").join(found.hint("merge"), ["key", "digest"]).select(
        "id", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + length).alias("stop"))
    joined = rows.join(spans_by_document(spans), "id", "left").select("id", "text", "spans")

    def apply(batches):
        for b in chunks(batches):
            n, gone, kept, cut = [], [], [], []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                data = (text or "").encode()
                out = union(spans or [])
                edges = [0, *[x for s in out for x in s], len(data)]
                left = b"".join([data[a:e] for a, e in zip(edges[::2], edges[1::2])])
                n.append(len(data))
                gone.append(len(data) - len(left))
                kept.append(left)
                cut.append([{"start": a, "stop": e} for a, e in out])
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["id", "n_bytes", "n_removed", "kept", "spans"])

    return joined.mapInArrow(apply, "id long, n_bytes long, n_removed long, kept binary, "
                                    "spans array<struct<start:long,stop:long>>").withColumnRenamed("id", id_col)
