"""Operator 8, packing: bounded-space online best-fit packing into windows of a fixed number of tokens.

A partition streams its documents through a fixed number of open windows.  A
document fills whole windows first; its rest goes into the open window that it
fits best.  If it fits none and no window may be opened, the fullest leaves:
as it is if hardly any room is left in it, else topped up with the head of the
rest, whose tail is placed anew.  The windows that are open at the end of a
partition are merged in groups of partitions, the only exchange.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import chunks, staged
from vellum.llm.pretokens import JsonVocabulary, vocabulary

CAPACITY = 1024
OPEN_WINDOWS = 64
#: Tokens of padding with which a window may leave.
SLACK = 4
#: Partitions whose open windows are merged together: the bound of a merging task.
MERGED = 64
SEPARATOR = 0


class TokenIds:
    """Ids of whole texts by a byte-level BPE ``.json`` vocabulary, special strings included.

    The merges run in tiktoken, from ranks read out of the same file; the tests
    hold the ids against the tokenizers library.
    """

    def __init__(self, path: str):
        self.vocab = JsonVocabulary(path)
        self.encoding = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=self.vocab.ranks(), special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        parts = self.vocab.segments(text)
        if len(parts) == 1:
            return self.encoding.encode_to_numpy(text)
        return np.concatenate([np.array([self.vocab.special[s]], np.uint32) if i % 2 else self.encoding.encode_to_numpy(s)
                               for i, s in enumerate(parts)])


@functools.lru_cache(maxsize=1)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


class Packer:
    """Open windows and the sequences that have left; a piece is (key, start, ids, document's tokens)."""

    def __init__(self, capacity: int, windows: int, slack: int, first: int):
        self.capacity, self.windows, self.slack, self.next = capacity, windows, slack, first
        self.room: list[tuple[int, int]] = []  # (free tokens, number of the window), ascending
        self.open: dict[int, list] = {}
        self.done: list[tuple] = []

    def leave(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.done.append((key, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def put(self, at: int, piece: tuple) -> None:
        free, window = self.room.pop(at)
        pieces = self.open[window]
        pieces.append(piece)
        free -= len(piece[2])
        if free:
            insort(self.room, (free, window))
        else:
            self.leave(self.open.pop(window))

    def add(self, key, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.leave([(key, start, ids[start:start + self.capacity], total)])
            start += self.capacity
        while start < total:
            rest = ids[start:]
            at = bisect_left(self.room, (len(rest), -1))
            if at < len(self.room):
                self.put(at, (key, start, rest, total))
                return
            if len(self.room) < self.windows:
                self.open[self.next] = [(key, start, rest, total)]
                insort(self.room, (self.capacity - len(rest), self.next))
                self.next += 1
                return
            free, window = self.room[0]
            if free <= self.slack:
                self.room.pop(0)
                self.leave(self.open.pop(window))
            else:
                self.put(0, (key, start, rest[:free], total))
                start += free


FIELDS = ["id", "start", "length", "crc", "total", "sequence", "offset", "part", "ids"]


def _batch(kind: pa.DataType, rows: list[tuple], part: int, left: bool) -> pa.RecordBatch:
    data = [r[2].astype("<u4").tobytes() for r in rows]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64()),
        pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
        pa.array([r[5] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()),
        pa.array(data if left else [None] * len(rows), pa.binary())], names=FIELDS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         windows: int = OPEN_WINDOWS, vocab: str | None = None) -> DataFrame:
    """Pieces of whole texts, each in one sequence of at most ``capacity`` tokens.

    A document's tokens are its text's ids and then id 0; a null or empty text
    is that id alone.  Columns: ``id_col``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.  Sequences are meant to be
    padded to ``capacity``; at most one in each merged group of partitions and
    those left with up to SLACK tokens of room are not full.  Null ids are kept,
    repeated rows are packed each, and an empty table gives an empty result;
    other columns are not read.

    Tokens move only for the windows left open (``windows`` a partition, MERGED
    partitions a task).  The pieces are staged once, so nothing is tokenized twice.
    """
    path = vocab or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = rows.schema["id"]
    schema = T.StructType([key, *[T.StructField(f, T.LongType()) for f in FIELDS[1:-1]], T.StructField("ids", T.BinaryType())])

    def run(batches):
        part, encode = TaskContext.get().partitionId(), token_ids(path)
        packer = Packer(capacity, windows, SLACK, part << 32)
        end, kind = np.array([SEPARATOR], np.uint32), None
        for b in chunks(batches):
            kind = b.schema.field("id").type
            for doc, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                packer.add(doc, np.concatenate((encode(text), end)) if text else end)
            if packer.done:
                yield _batch(kind, packer.done, part, False)
                packer.done = []
        for pieces in packer.open.values():
            packer.leave(pieces)
        if packer.done:
            yield _batch(kind, packer.done, part, True)

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        """Windows, fullest first, laid end to end and cut at every ``capacity`` tokens."""
        got = table.select(["id", "start", "total", "sequence", "offset", "ids"]).to_pylist()
        fill: dict[int, int] = {}
        for r in got:
            fill[r["sequence"]] = fill.get(r["sequence"], 0) + len(r["ids"]) // 4
        got.sort(key=lambda r: (-fill[r["sequence"]], r["sequence"], r["offset"]))
        sequence, offset, out = 1 << 62 | group[0].as_py() << 32, 0, []
        for r in got:
            ids, start = np.frombuffer(r["ids"], "<u4"), r["start"]
            while len(ids):
                head = ids[:capacity - offset]
                out.append((r["id"], start, head, r["total"], sequence, offset))
                ids, start, offset = ids[len(head):], start + len(head), offset + len(head)
                if offset == capacity:
                    sequence, offset = sequence + 1, 0
        return pa.Table.from_batches([_batch(table.schema.field("id").type, out, group[0].as_py(), False)])

    pieces = staged(rows.mapInArrow(run, schema), "pieces")
    left = pieces.where("ids is not null")
    merged = left.withColumn("group", F.floor(F.col("part") / MERGED)).groupBy("group").applyInArrow(merge, schema)
    return pieces.where("ids is null").unionByName(merged).select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), "offset")
