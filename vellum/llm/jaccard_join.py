"""Operator 2, n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

Two sets that are similar enough differ in a bounded number of shingles.  Their
sizes put the pair into a band, the band says into how many parts the hash range
is cut, and by the pigeonhole principle the two sets agree in one whole part: a
part's content is the key of a tile.  Sets whose shingles fall into too few parts
are cut anew by another hash, and in the end keyed by their smallest shingles, so
that every key has content of the set.  Within tiles, the bits that one set's
bitmap has and the other's has not bound the overlap from above; pairs that
pass are verified by exact intersection of the sorted shingle arrays.

Only classes are asked for, so a tile first compares its members with one
leader; members of tiles that are still in several classes after that are
compared with each other, those of different classes.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, components, runs, staged
from vellum.llm.words import M1, Words, mix

#: Rows of one side of a tile that are compared at once.
TILE = 1024
#: Bits of a bitmap for each shingle: so wide that most differences of two sets show.
BITS = 4
#: Members that one task compares with a leader.
STREAM = 8192
MAX_SIZE = 1 << 40
#: Hashes by which a band is cut one after another for sets that fill too few parts.
CUTS = 3


class Bands:
    """Bands of pairs by the number of shingles they may differ in."""

    def __init__(self, percent: int):
        self.percent = percent
        self.parts = [3]
        while self.parts[-1] < MAX_SIZE:
            self.parts.append(self.parts[-1] * 3 // 2 + 1)
        self.parts = np.array(self.parts, np.int64)
        # the most differences d for which a band's parts suffice: d + 1, and some more so that few parts are empty
        d = self.parts * 16 // 17
        while (bad := d + d // 16 + 2 > self.parts).any():
            d[bad] -= 1
        # sets that may not differ at all are keyed whole
        self.parts, self.differences = np.append(1, self.parts), np.append(0, d)

    def of(self, a: int, b: int) -> int:
        """Band of a pair of sizes."""
        return int(np.searchsorted(self.differences, (a + b) * (100 - self.percent) // (100 + self.percent)))

    def around(self, n: int) -> range:
        """Bands that a set of n shingles may share with a similar one."""
        return range(self.of(n, -(-n * self.percent // 100)), self.of(n, n * 100 // self.percent) + 1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    words = Words(texts, lower=True)
    grams, n = words.grams(k)
    ends, count = np.cumsum(n), words.counts()
    out = []
    for d in range(len(texts)):
        if n[d]:
            out.append(np.unique(grams[ends[d] - n[d]:ends[d]]))
        elif count[d]:
            own = words.hashes[words.first[d]:words.first[d + 1]]
            value = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def tile_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles of a set: one for each part that is not empty, in each of its bands.

    If the parts that are not empty outnumber a band's differences, a similar set
    agrees in one of those.  Else it may be that two similar sets agree in empty
    parts only, but then both fill too few: both are cut by the next hash as well.
    After the last, the smallest shingles are keys: one more of them than the
    band's differences, so the smallest that two similar sets share is among both's.
    """
    out = []
    for band in bands.around(len(shingles)):
        parts, differences = int(bands.parts[band]), int(bands.differences[band])
        for cut in range(CUTS + 1):
            salt = np.uint64(((band * (CUTS + 1) + cut) * 2 + 1) * int(M1) % (1 << 64))
            if cut == CUTS:
                out.append(mix(mix(shingles[:differences + 1]) ^ mix(shingles[:differences + 1] + salt)))
                break
            value, own = shingles, shingles
            if cut:
                value = mix(shingles + salt)
                order = np.argsort(value)
                value, own = value[order], shingles[order]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own))))
            if parts < 1 << 31:
                part = (value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascending, as the values are
            else:
                part = value // np.uint64((1 << 64) // parts + 1)
            last = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            before = np.concatenate((np.zeros(1, np.int64), last[:-1]))
            out.append(mix((total[last] - total[before]) ^ mix(part[last - 1] + salt)))
            if len(last) > differences:
                break
    return np.concatenate(out)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: 64-bit words, a power of two of them, about BITS bits for each shingle."""
    n = 1 << max(0, int(BITS * len(shingles) - 1).bit_length() - 6)
    bit = (shingles >> np.uint64(8)) & np.uint64(64 * n - 1)
    flags = np.zeros(64 * n, np.uint8)
    flags[bit.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, n: int) -> np.ndarray:
    """Bitmaps (rows) folded to n words: the bitmap of the same set at that width."""
    while bits.shape[1] > n:
        bits = bits[:, :bits.shape[1] // 2] | bits[:, bits.shape[1] // 2:]
    return bits


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def overlap_bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most shingles that sets may share: each loses at least the bits that the other lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def jaccard_classes(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    Two documents link if 100 * intersection >= ``percent`` * union of their
    sets of ``words``-word shingles (A-Z in lower case); a component has the
    smallest id that links lead to.  Null and blank texts have empty sets and
    link with nothing, nor do rows with a null id, whose component is null.
    Rows that repeat an id are one document if their texts are equal, and
    otherwise linked under that id; each row is returned.  An empty table gives
    an empty result; other columns are not read.  A text is always taken whole.

    Copies in one partition are collapsed before the first shuffle, which
    carries tile keys and ids only.  Tiles and leaders with many members are
    dealt to several tasks; tasks stream over sorted rows and hold one tile.
    """
    bands = Bands(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sketch(batches):
        seen: dict[bytes, int] = {}  # copies within the partition: 16 bytes of hash each
        for b in chunks(batches):
            ids, same, sizes, keys, bits = b["id"].to_pylist(), [], [], [], []
            for i, s in zip(ids, shingle_sets(b["text"].to_pylist(), words)):
                first = i
                if i is not None and len(s):
                    first = seen.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), i)
                new = i is not None and len(s) > 0 and first == i
                same.append(first)
                sizes.append(len(s))
                keys.append(tile_keys(s, bands).view(np.int64) if new else None)
                bits.append(bitmap(s).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(sizes, pa.int64()), pa.array(same, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(bits, pa.binary())], names=["id", "n", "same", "keys", "bits"])

    def shared(batches):
        """Of rows sorted by (key, id): those of keys with several ids, and the key's smallest id."""
        key = lead = None
        alone = False  # the last key's only row has not been returned
        for b in batches:
            if not b.num_rows:
                continue
            k, i = b["key"].to_numpy(), b["id"].to_numpy()
            new = np.append(True, k[1:] != k[:-1])
            goes_on = key is not None and k[0] == key
            at = np.flatnonzero(new)
            leads = i[at].copy()
            if goes_on:
                leads[0] = lead
            n = np.diff(np.append(at, len(k)))
            leader = np.repeat(leads, n)
            keep = (leader != i)
            several = np.logical_or.reduceat(keep, at)
            head = np.zeros(len(k), bool)
            head[at] = several
            if goes_on:
                head[0] = False
            out = keep | head
            ok, oi, ol = k[out], i[out], leader[out]
            if alone and goes_on and several[0]:
                ok, oi, ol = np.append(key, ok), np.append(lead, oi), np.append(lead, ol)
            alone = (alone and not several[0]) if goes_on and len(at) == 1 else not several[-1]
            key, lead = k[-1], leads[-1]
            yield pa.RecordBatch.from_arrays([pa.array(ok), pa.array(oi), pa.array(ol)], names=["key", "id", "lead"])

    sets = staged(rows.mapInArrow(sketch, "id long, n long, same long, keys array<long>, bits binary"), "sets")
    keyed = sets.where("keys is not null").select(F.explode("keys").alias("key"), "id")
    # documents that share tiles with a tile's smallest one, and how many
    shares = staged(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(
        shared, "key long, id long, lead long").where("id <> lead").groupBy("lead", "id").agg(F.count(F.lit(1)).alias("tiles")),
        "shares")
    near = shares.select("id").union(shares.select("lead")).distinct()
    # the number of near documents has no bound, so they are not broadcast
    texts = staged(rows.hint("merge").join(near, "id"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that link.  A leader a of many members goes to several tasks."""
        many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("tasks"))
        dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "tasks").alias("task"))
        asked = (dealt.select("a", "task", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()
                 .unionByName(dealt.select("a", "task", F.lit(1).alias("role"), F.col("b").alias("id"))))
        told = asked.join(texts, "id")

        def judge(batches):
            lead, head, width = None, None, None
            for b in chunks(batches):
                a, task, role, ids = (b[c].to_pylist() for c in ("a", "task", "role", "id"))
                out = []
                for i, s in enumerate(shingle_sets(b["text"].to_pylist(), words)):
                    if role[i] == 0:
                        if lead != (a[i], task[i]):  # of rows that repeat the leader's id, the first
                            lead, head = (a[i], task[i]), s
                            width = bitmap(s)
                        continue
                    bits = bitmap(s)
                    n = min(len(bits), len(width))
                    bound = overlap_bound(fold(width[None], n), len(head), fold(bits[None], n), len(s))[0]
                    if bound * (100 + percent) >= percent * (len(head) + len(s)) and similar(head, s, percent):
                        out.append((a[i], ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                                  pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        return staged(told.repartition("a", "task").sortWithinPartitions("a", "task", "role", "id")
                      .select("a", "task", "role", "id", "text").mapInArrow(judge, "a long, b long"), "verified")

    # each document with the leader that it shares most tiles with
    stars = shares.groupBy("id").agg(F.max_by("lead", F.struct("tiles", (-F.col("lead")).alias("x"))).alias("a")).select(
        "a", F.col("id").alias("b"))
    links = verified(stars)
    part = components(links)

    # leaders whose documents are still in several classes: members of different classes, by bitmap
    members = shares.select("lead", "id").unionByName(shares.select("lead", F.col("lead").alias("id")).distinct())
    members = members.join(part.withColumnRenamed("node", "id"), "id", "left").select(
        "lead", "id", F.coalesce("component", "id").alias("class"))
    mixed = members.groupBy("lead").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("lead")
    members = members.join(mixed, "lead")
    blocks = members.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    members = members.join(blocks, "lead").join(sets.where("bits is not null").select("id", "n", "bits"), "id")
    own = F.pmod(F.xxhash64("id"), "blocks")
    placed = members.select("lead", "id", "class", "n", "bits", own.alias("own"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("lead", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                           "own", "id", "class", "n", "bits")

    def compare(batches):
        for t in runs(batches, ["lead", "x", "y"]):
            ids, cls, n = (t[c].to_numpy() for c in ("id", "class", "n"))
            if (cls == cls[0]).all():
                continue
            own = t["own"].to_numpy()
            x, y = t["x"][0].as_py(), t["y"][0].as_py()
            bits = [np.frombuffer(v.as_py(), np.uint64) for v in t["bits"]]
            width = np.array([len(v) for v in bits])
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            found = []
            for w in np.unique(width):  # a row meets those with as wide a bitmap or a wider one, folded to its width
                folded = np.stack([fold(v[None], w)[0] if len(v) >= w else np.zeros(w, np.uint64) for v in bits])
                for i in np.flatnonzero(width == w):
                    others = right if own[i] == x else left
                    first = ids[others] > ids[i] if x == y else own[i] == x  # of two equally wide rows, one asks
                    near = others[(width[others] > w) | (width[others] == w) & first]
                    near = near[(cls[near] != cls[i]) & (np.minimum(n[i], n[near]) * 100 >= percent * np.maximum(n[i], n[near]))]
                    near = near[overlap_bound(folded[i], n[i], folded[near], n[near]) * (100 + percent) >= percent * (n[i] + n[near])]
                    found.append(np.column_stack((np.minimum(ids[i], ids[near]), np.maximum(ids[i], ids[near]))))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    left = staged(placed.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y").mapInArrow(
        compare, "a long, b long").distinct(), "left")
    if not left.isEmpty():
        part = components(links.unionByName(verified(left)).unionByName(
            sets.where("same <> id").select(F.col("same").alias("a"), F.col("id").alias("b"))))
    else:
        part = components(links.unionByName(sets.where("same <> id").select(F.col("same").alias("a"), F.col("id").alias("b"))))
    return sets.select("id", "n").join(part.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
