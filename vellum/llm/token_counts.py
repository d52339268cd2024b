"""Operator 3, token counts: rank-synchronous merging of ragged arrays of pre-tokens.

Each worker splits whole texts into pre-tokens, holds the pre-tokens it has not
met yet as one ragged numpy array of symbols, and applies the lowest-rank pair
of every sequence at the same time until no sequence has a pair left.  A
document's tokens are the sum over its pre-tokens.  Row-local: no shuffle, so
hot sources and groups of copies cost what other rows cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import chunks
from vellum.llm.pretokens import MEMO_ENTRIES, JsonVocabulary, splitter, vocabulary

NONE = np.iinfo(np.int32).max


class RankMerger:
    """Counts the BPE symbols that survive in each of many byte strings."""

    def __init__(self, vocab: JsonVocabulary):
        left = np.array([vocab.ids[a] for a, _ in vocab.merges], np.int64)
        right = np.array([vocab.ids[b] for _, b in vocab.merges], np.int64)
        self.made = np.array([vocab.ids[a + b] for a, b in vocab.merges], np.int32)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bytes = np.array(vocab.byte_ids, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE).astype(np.int32)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = n.copy()
        live = np.flatnonzero(n > 1)  # places in out
        if not len(live):
            return out
        sym = self.bytes[np.frombuffer(b"".join(pieces[i] for i in live), np.uint8)]
        length = n[live]
        starts = np.cumsum(length) - length
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that begins at a symbol
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[starts[1:] - 1] = NONE
        while len(live):
            low = np.minimum.reduceat(rank, starts)
            go = low < NONE
            if not go.all():  # finished sequences leave
                out[live[~go]] = length[~go]
                keep = np.repeat(go, length)
                sym, rank, live, length, low = sym[keep], rank[keep], live[go], length[go], low[go]
                starts = np.cumsum(length) - length
                continue
            merge = rank == np.repeat(low, length)
            if (merge[1:] & merge[:-1]).any():  # x x x: the pairs at even places of a run, from the left
                place = np.arange(len(merge))
                begin = np.maximum.accumulate(np.where(merge, -1, place))
                merge &= (place - begin) % 2 == 1
            gone = np.zeros(len(sym), bool)
            gone[1:] = merge[:-1]
            sym[merge] = self.made[rank[merge]]
            stale = merge.copy()
            stale[:-1] |= merge[1:]
            stale[:-2] |= merge[2:] & gone[1:-1]  # the symbol before one that has gone now sees the next
            length = length - np.add.reduceat(merge.astype(np.int64), starts)
            sym, rank, stale = sym[~gone], rank[~gone], stale[~gone]
            starts = np.cumsum(length) - length
            last = np.zeros(len(sym), bool)
            last[starts + length - 1] = True
            rank[last] = NONE
            at = np.flatnonzero(stale & ~last)
            rank[at] = self.ranks(sym[at], sym[at + 1])
        return out


class TokenCounter:
    """Token counts of whole texts, with a bounded memo of pre-tokens."""

    def __init__(self, path: str):
        self.vocab = JsonVocabulary(path)
        self.merger = RankMerger(self.vocab)
        self.split = splitter()
        self.memo: dict[str, int] = {}

    def __call__(self, texts: Iterable[str]) -> list[int]:
        out, found, fresh = [], [], set()
        for text in texts:
            parts = self.vocab.segments(text)
            tokens = [t for s in parts[::2] for t in self.split(s)] if len(parts) > 1 else self.split(text)
            found.append((tokens, len(parts) // 2))
            fresh.update(tokens)
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo.clear()
        fresh = [t for t in fresh if t not in self.memo]
        self.memo.update(zip(fresh, self.merger.counts([t.encode() for t in fresh]).tolist()))
        get = self.memo.__getitem__
        for tokens, special in found:
            out.append(sum(map(get, tokens)) + special)
        return out


@functools.lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    """The worker's counter: later tasks of the same worker go on with its memo."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 vocab: str | None = None) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids are kept, repeated
    rows are counted each, an empty table gives an empty result; other columns
    are not read, so their names don't matter.  A very long text is one pass of
    its own and is never cut.
    """
    path = vocab or vocabulary("byte_bpe_50k.json")

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
                       .alias("bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches):
        counter = token_counter(path)
        for b in chunks(batches):
            texts = ["" if x is None else x for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["bytes"], pa.array(counter(texts), pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()),
                                             T.StructField("n_tokens", T.LongType())]))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
