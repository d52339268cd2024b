"""Fragments around passages that occur several times, for the two passage operators.

A window (so many consecutive units of a text) has an anchor: its gram with the
smallest hash, the leftmost of equals.  Equal windows have equal anchors at the
same place, so all of them meet under the anchor's key.  Successive windows with
one anchor make one fragment.  Only anchors that occur several times are worth
it: the first exchange carries anchor keys and ids, the second the fragments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, staged

#: Fragments that one Arrow batch holds.
FRAGMENTS = 20_000
#: Values that are hashed or compared at once.
BLOCK = 1 << 16


@dataclass
class Runs:
    """Fragments of a chunk of texts: text, anchor key, first unit, windows, bytes of ``data``."""

    doc: np.ndarray
    key: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: bytes


def first_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` successive values, the leftmost of equals, at every place.

    Values are compared by their high 40 bits.  Blocks of BLOCK values stay in
    the processor's cache; places within a block and ``width`` fit the low 24 bits.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for s in range(0, n, BLOCK):
        part = values[s:s + BLOCK + width - 1]
        out[s:s + BLOCK] = _first_min(part, width) + s
    return out


def _first_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    low = np.uint64((1 << 24) - 1)
    keyed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    if width <= 16:
        best = keyed[:n].copy()
        for j in range(1, width):
            np.minimum(best, keyed[j:n + j], out=best)
    else:
        blocks = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        blocks[:len(keyed)] = keyed
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return (best & low).astype(np.int64)


def cut_runs(anchor: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows of one text with one anchor: text, first window, number of windows.

    ``anchor``: of the window at every place; text d has ``count[d]`` windows, from place ``first[d]``.
    """
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3
    some = np.flatnonzero(count)
    start = np.unique(np.concatenate((np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, first[some], first[some] + count[some])))
    start = start[start < len(anchor)]
    size = np.diff(np.append(start, len(anchor)))
    doc = np.searchsorted(first, start, side="right") - 1
    whole = (doc >= 0) & (doc < len(count))
    whole[whole] = start[whole] - first[doc[whole]] < count[doc[whole]]
    return doc[whole], start[whole], size[whole]


def repeated_fragments(rows: DataFrame, runs: Callable[[list], Iterator[Runs]], across: bool) -> DataFrame:
    """``key``, ``id``, ``start``, ``windows``, ``data`` of every fragment whose anchor occurs several times.

    ``rows``: ``id long`` (rows with a null id have no fragments), ``text``.
    ``runs`` takes texts.  ``across``: in several documents; else at several
    places, one document included.  Rows that repeat an id and a text are one
    document.  The keys stream through sorted tasks, so a hot anchor costs time
    in one task but no memory; its rows are 8-byte keys and ids.
    """
    rows = rows.where(F.col("id").isNotNull())

    def anchors(batches):
        for b in chunks(batches):
            n = b.num_rows
            keys, places = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
            for r in runs(b["text"].to_pylist()):
                cuts = np.searchsorted(r.doc, np.arange(n + 1))
                for d in range(n):
                    if cuts[d] < cuts[d + 1]:
                        keys[d] = np.append(keys[d], r.key[cuts[d]:cuts[d + 1]].view(np.int64))
                        places[d] = np.append(places[d], r.start[cuts[d]:cuts[d + 1]])
            found, places = ([np.unique(k) for k in keys], [None] * n) if across else (keys, places)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                names=["id", "keys", "places"])

    def several(batches):
        """Of rows sorted by (key, id, place): ids and keys of those whose key has several ids (or places)."""
        key = first = None
        held = False  # the last key has had one id (place) so far, which was not returned
        for b in batches:
            if not b.num_rows:
                continue
            k, i = b["key"].to_numpy(), b["id"].to_numpy()
            p = i if across else b["place"].to_numpy()
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            n = np.diff(np.append(at, len(k)))
            goes_on = key is not None and k[0] == key
            fi, fp = i[at].copy(), p[at].copy()
            if goes_on:
                fi[0], fp[0] = first
            differs = (i != np.repeat(fi, n)) | (p != np.repeat(fp, n))
            many = np.logical_or.reduceat(differs, at)
            if goes_on and not held:
                many[0] = True
            out = np.repeat(many, n)
            oi, ok = i[out], k[out]
            if goes_on and held and many[0]:
                oi, ok = np.append(first[0], oi), np.append(key, ok)
            held = not many[-1]
            key, first = k[-1], (fi[-1], fp[-1])
            yield pa.RecordBatch.from_arrays([pa.array(oi), pa.array(ok)], names=["id", "key"])

    found = rows.mapInArrow(anchors, "id long, keys array<long>, places array<long>")
    if across:
        flat = found.select(F.explode("keys").alias("key"), "id")
        order = ["key", "id"]
    else:
        flat = found.select("id", F.explode(F.arrays_zip("keys", "places")).alias("x")).select(
            F.col("x.keys").alias("key"), "id", F.col("x.places").alias("place"))
        order = ["key", "id", "place"]
    hits = staged(flat.repartition("key").sortWithinPartitions(*order).mapInArrow(several, "id long, key long"), "hits")
    wanted = hits.groupBy("id").agg(F.collect_set("key").alias("keys"))

    def cut(batches):
        for b in chunks(batches):
            ids, want = b["id"].to_pylist(), [np.sort(w.values.to_numpy().view(np.uint64)) for w in b["keys"]]
            for r in runs(b["text"].to_pylist()):
                cuts = np.searchsorted(r.doc, np.arange(len(ids) + 1))
                wanted = np.zeros(len(r.doc), bool)
                for d in np.flatnonzero(np.diff(cuts)):
                    own = r.key[cuts[d]:cuts[d + 1]]
                    wanted[cuts[d]:cuts[d + 1]] = want[d][np.minimum(np.searchsorted(want[d], own), len(want[d]) - 1)] == own
                at = np.flatnonzero(wanted)
                for x in (at[s:s + FRAGMENTS] for s in range(0, len(at), FRAGMENTS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.key[x].view(np.int64)), pa.array([ids[d] for d in r.doc[x]], pa.int64()),
                         pa.array(r.start[x]), pa.array(r.windows[x].astype(np.int32)),
                         pa.array([r.data[a:e] for a, e in zip(r.begin[x].tolist(), r.end[x].tolist())], pa.binary())],
                        names=["key", "id", "start", "windows", "data"])

    return rows.join(wanted, "id").select("id", "text", "keys").mapInArrow(
        cut, "key long, id long, start long, windows int, data binary")


@dataclass
class Shard:
    """Fragments of successive keys in order of (key, id, start); ``texts`` has each content once."""

    key: np.ndarray
    id: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    text: np.ndarray  # place in texts
    texts: list[bytes]
    goes_on: bool  # its first key is the last key of the shard before


def shards(batches: Iterator[pa.RecordBatch], limit: int, split: bool) -> Iterator[Shard]:
    """Cut sorted fragments into shards of about ``limit`` bytes of distinct content.

    Cuts lie between keys; ``split`` allows them within a key that has more than
    twice the limit.  Copies take a few numbers each.
    """
    rows: list[tuple[np.ndarray, ...]] = []
    place: dict[bytes, int] = {}
    size, last = 0, None

    def shard() -> Shard:
        nonlocal rows, place, size, last
        out = Shard(*[np.concatenate(c) for c in zip(*rows)], list(place), False)
        out.goes_on = last == out.key[0]
        rows, place, size, last = [], {}, 0, out.key[-1]
        return out

    for b in batches:
        key, own, start, windows = (b[c].to_numpy() for c in ("key", "id", "start", "windows"))
        begin, at, data = 0, [], b["data"].to_pylist()
        before = rows[-1][0][-1] if rows else None

        def take(end):
            if end > begin:
                rows.append((key[begin:end], own[begin:end], start[begin:end], windows[begin:end], np.array(at, np.int64)))

        for i, text in enumerate(data):
            if size >= limit and (key[i] != before or split and size >= 2 * limit):
                take(i)
                yield shard()
                begin, at = i, []
            before = key[i]
            known = len(place)
            p = place.setdefault(text, known)
            size += len(text) if p == known else 0
            at.append(p)
        take(len(data))
    if rows:
        yield shard()


def stretches(shard: Shard, row: np.ndarray, offset: np.ndarray, window: int) -> pa.RecordBatch:
    """What the windows at ``offset`` of the fragments ``row`` (both ascending) cover.

    Any two windows of a fragment overlap or touch, so it is one stretch for each.
    """
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(row)) - 1 if len(at) else at
    r = row[at]
    return pa.RecordBatch.from_arrays([pa.array(shard.id[r]), pa.array(shard.start[r] + offset[at]),
                                       pa.array(shard.start[r] + offset[last] + window)], names=["id", "start", "stop"])


def spans_by_document(spans: DataFrame) -> DataFrame:
    """``id``, ``spans``: the covered stretches (first unit, unit behind the last) of each document, in order."""
    return spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def union(spans: list) -> list[tuple[int, int]]:
    """Disjoint, maximal stretches of sorted ones."""
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = (s["start"], s["stop"])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
