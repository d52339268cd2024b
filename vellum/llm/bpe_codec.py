"""Operator 5, byte-level BPE encoding and decoding as a monoid tree reduction.

The encoding of a byte string is reduced from the encodings of its halves.  Two
neighbours are joined by re-encoding a window around their boundary: at first
the last token of the left and the first of the right.  A token sequence is the
BPE encoding of its bytes exactly if every two neighbouring tokens are the
encoding of their own concatenation; so once the window's ends agree with the
tokens next to them, nothing outside can change.  Until then the window grows on
the side that disagrees, by twice as many tokens each time.  Decoding concatenates token bytes
up the same tree.  Pre-tokens are encoded apart from each other, so above them
the join is plain concatenation.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import chunks
from vellum.llm.pretokens import MEMO_ENTRIES, rank_file, splitter, vocabulary

#: Bytes of a leaf, merged directly.
LEAF = 4
#: Bytes up to which listing all pairs again is quicker than a heap.
SHORT = 24
#: Tokens of a window, and characters of a pre-token, that a memo keeps; longer ones are done anew, so a memo's bytes are bounded.
MEMO_TOKENS, MEMO_CHARS = 8, 64
NONE = 1 << 62


class Codec:
    """Encodes and decodes byte strings with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], memo_entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.shown = {i: str(i).encode() for i in ranks.values()}
        self.memo_entries = memo_entries
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.leaves: dict[bytes, tuple[int, ...]] = {b"": ()}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Direct BPE of a byte string: lowest rank first, leftmost on ties."""
        if len(data) > SHORT:
            return self.merge_long(data)
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == NONE:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple([self.ranks[p] for p in parts])

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs over a linked list of parts: n log n steps for n bytes."""
        get, n = self.ranks.get, len(data)
        parts: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i + 1]) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, right = heapq.heappop(heap)
            j = behind[i] if parts[i] is not None else n
            # a pair whose parts have changed has another rank: ranks tell byte strings apart
            if j >= n or parts[j] != right or get(parts[i] + right) != rank:
                continue
            parts[i] += right
            parts[j] = None
            behind[i] = k = behind[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[k]))
            h = before[i]
            if h >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[i]))
        return tuple([self.ranks[p] for p in parts if p is not None])

    def remerge(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of a window's bytes."""
        if len(ids) > MEMO_TOKENS:
            return self.merge(self.decode(ids))
        known = self.windows.get(ids)
        if known is None:
            if len(self.windows) >= self.memo_entries:
                self.windows.clear()
            known = self.windows[ids] = self.merge(self.decode(ids))
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are next to each other."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= self.memo_entries:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.remerge((a, b)) == (a, b)
        return known

    def leaf(self, data: bytes) -> tuple[int, ...]:
        known = self.leaves.get(data)
        if known is None:
            if len(self.leaves) >= self.memo_entries:
                self.leaves.clear()
            known = self.leaves[data] = self.merge(data)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenated bytes of two encodings."""
        remerge = self.remerge
        i, j, step = len(left) - 1, 1, 1
        while True:
            window = remerge(left[i:] + right[:j])
            grow_left = i > 0 and not self.stable(left[i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            i = max(0, i - step * grow_left)
            j = min(len(right), j + step * grow_right)
            step *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        left, right = self.encode(data[:half]), self.encode(data[half:])
        if self.stable(left[-1], right[0]):
            return left + right
        return self.join(left, right)

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= 8:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Whole texts: each pre-token is encoded once per memo, then its ids and bytes are concatenated."""

    def __init__(self, path: str):
        self.codec = Codec(rank_file(path))
        self.split = splitter()
        self.memo: dict[str, tuple[bytes, bytes]] = {}  # by pre-token: its ids as text, the bytes decoded from them

    def learn(self, piece: str) -> tuple[bytes, bytes]:
        ids = self.codec.encode(piece.encode())
        entry = (b" ".join([self.codec.shown[i] for i in ids]), self.codec.decode(ids))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[piece] = entry
        return entry

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids joined by blanks, hash of the bytes decoded from them."""
        pieces = self.split(text)
        found = list(map(self.memo.get, pieces))
        if None in found:
            found = [f or self.memo.get(p) or self.learn(p) for f, p in zip(found, pieces)]
        ids = b" ".join([f[0] for f in found])
        data = b"".join([f[1] for f in found])
        return (ids.count(b" ") + 1 if pieces else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest())

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.codec.encode(piece.encode())]


@functools.lru_cache(maxsize=1)
def text_codec(path: str) -> TextCodec:
    """The worker's codec: later tasks of the same worker go on with its memo."""
    return TextCodec(path)


@contextlib.contextmanager
def without_gc():
    """The memos hold no cycles, and scanning them would cost more than the encoding; other tasks of the worker get it back."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _kind(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """Ids of every whole text: ``id_col``, ``ids array<int>``.

    A null text gives no ids.  Null ids are kept, repeated rows are encoded each, an
    empty table gives an empty result; other columns are not read.
    """
    path = vocab or vocabulary("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        codec = text_codec(path)
        with without_gc():
            for b in chunks(batches):
                ids = [codec.encode(x or "") for x in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", _kind(rows, "id")), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None) -> DataFrame:
    """Bytes of every row of ids: ``id_col``, ``data binary``.  Null ids give no bytes; an unknown id is an error."""
    path = vocab or vocabulary("byte_bpe_50k.tiktoken")
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        codec = Codec(rank_file(path))
        for b in batches:
            data = [codec.decode(tuple(x or ())) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(data, pa.binary())], names=["id", "data"])

    schema = T.StructType([T.StructField("id", _kind(rows, "id")), T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "data")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """Digest of encoding and decoding every whole text: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    A null text counts as empty (the hashes of nothing).  Null ids are kept,
    repeated rows are encoded each, an empty table gives an empty result; other
    columns are not read.  Row-local, one text at a time: no shuffle.
    """
    path = vocab or vocabulary("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        codec = text_codec(path)
        with without_gc():
            for b in chunks(batches):
                n, ids, data = zip(*[codec.digests(x or "") for x in b["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(data)],
                                                 names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("id", _kind(rows, "id")), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
