"""Operator 6, sharding: a uniform shuffle into shards of exact sizes.

The hypergeometric communication matrix says how many rows each block of the
input sends to each cell of the output.  Drawn exactly from the row counts, it
makes the shuffle uniform although every block and cell permutes on its own:
rows are permuted within their block, cut at the block's counts, exchanged, and
permuted again within their cell.  Only DataFrame functions touch the rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one block or cell should hold; beyond MOST_CELLS of them they grow instead (their sorts spill).
CELL_ROWS = 2_000_000
MOST_CELLS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact inversion around the mode; numpy's own sampler ends at 10^9 rows."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    share = good / (good + bad)
    spread = int(14 * math.sqrt(draws * share * (1 - share)) + 50)
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(step)))
    total = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def communication_matrix(block_rows: list[int], cell_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each cell; row and column sums are the given counts."""
    if sum(block_rows) != sum(cell_rows):
        raise ValueError("blocks and cells must hold equally many rows")
    rng, room, out = np.random.default_rng(seed), list(cell_rows), []
    for n in block_rows:
        left, sent = sum(room), []
        for r in room:
            x = hypergeometric(rng, r, left - r, n)
            sent.append(x)
            left, n = left - r, n - x
        room = [r - x for r, x in zip(room, sent)]
        out.append(sent)
    return out


def even_sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def shuffle_to_shards(df: DataFrame, id_col: str, shards: int, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 up to ``shards`` - 1) and ``slot`` (gapless from 0 within the shard).

    Every permutation of the rows is equally likely, up to the quality of the
    hash; shard sizes differ by one at most.  The same seed gives the same
    result again, so a recomputed task agrees with the lost one.  Rows are told
    apart by a hash of their id, then by their other columns: null ids and
    repeated rows are dealt out like others, and only equal rows may swap
    places.  An empty table gives an empty result.  Columns of ``df`` named
    ``shard`` or ``slot`` are replaced.

    What reaches the driver is one count per block.  The matrix that is
    broadcast has MOST_CELLS x MOST_CELLS numbers at most, whatever the input.
    """
    n = df.count()
    blocks = min(MOST_CELLS, max(16, math.ceil(n / cell_rows)))
    parts = min(max(1, MOST_CELLS // shards), max(1, math.ceil(n / shards / cell_rows)))
    cells = [c for s in even_sizes(n, shards) for c in even_sizes(s, parts)]
    draw = F.xxhash64(F.lit(seed), F.col(id_col))
    block = F.pmod(draw, F.lit(blocks)).cast("int")
    counts = dict(df.groupBy(block.alias("block")).count().collect())
    sent = communication_matrix([counts.get(b, 0) for b in range(blocks)], cells, seed)
    cuts = json.dumps([{"block": b, "cuts": np.cumsum(x).tolist()} for b, x in enumerate(sent)])
    matrix = df.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(cuts), "array<struct<block:int,cuts:array<bigint>>>"))).select(
        F.col("block").alias("_block"), F.col("cuts").alias("_cuts"))
    first = []  # slot of the first row of each cell
    for i, c in enumerate(cells):
        first.append(0 if i % parts == 0 else first[-1] + cells[i - 1])

    names = [c for c in df.columns if c not in ("shard", "slot")]
    rest = [F.col(c) for c in names if c != id_col]
    rows = df.select(*names, draw.alias("_draw"), block.alias("_block"))
    within = Window.partitionBy("_block").orderBy("_draw", id_col, *rest)
    dealt = (rows.withColumn("_rank", F.row_number().over(within) - 1)
             .join(F.broadcast(matrix), "_block")
             .withColumn("_cell", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))))
             .select(*names, "_cell", F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("_rank")).alias("_draw")))
    again = Window.partitionBy("_cell").orderBy("_draw", id_col, *rest)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("_cell") + 1)
    return dealt.select(*names, F.floor(F.col("_cell") / parts).cast("int").alias("shard"),
                        (F.row_number().over(again) - 1 + start).cast("long").alias("slot"))
