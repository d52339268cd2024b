"""Operator 12, hard negatives by slot decomposition.

An anchor's positives are its best rows of its own label.  Each positive opens a
window of scores for negatives, from a share of its score up to a larger share.
The upper limits of an anchor's windows cut all scores into disjoint slots.
Every block of rows keeps the best few of each slot, and blocks combine to the
best few of each slot overall.  Slots merged from the lowest upwards give the
best few below every upper limit; of these, a window takes the ones above its
lower limit.  So windows that overlap share one search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import staged

#: Rows of a block and anchors of a part: what a task holds.
BLOCK_ROWS = 16384
PART_ROWS = 1024
#: Anchors that are scored at once.
STRIP = 64
LIMITS = "array<long>"


def wide(flat: np.ndarray, width: int) -> np.ndarray:
    """Rows as doubles where all products and sums are exact whole numbers, else as Python's integers."""
    exact = width * float(np.abs(flat.astype(np.float64)).max(initial=0)) ** 2 < 2 ** 52
    return flat.reshape(-1, width).astype(np.float64 if exact else object)


def long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; larger ones are cut to that range."""
    return scores.astype(np.int64) if scores.dtype != object else np.clip(scores, 1 - 2 ** 63, 2 ** 63 - 1).astype(np.int64)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, ties to the smaller place."""
    some = np.arange(len(score))
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.argsort(-score[some], kind="stable")[:k]]


def by_slots(score: np.ndarray, upper: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """Places of the k best of every slot; ``upper`` falls, slot j holds scores in (upper[j + 1], upper[j]]."""
    out = []
    slot = len(upper) - 1 - np.searchsorted(upper[::-1], score)
    for j in range(len(upper)):
        some = np.flatnonzero(slot == j)
        if len(some):
            out.append((j, some[best(score[some], k)]))
    return out


class Block:
    """Distinct rows of one width in order of their ids, and the anchors to be held against them."""

    def __init__(self, table: pa.Table):
        width = table["width"][0].as_py()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors, ids, labels = flat.reshape(len(asks), width), table["id"].to_numpy(), table["label"].to_numpy()
        keep = np.unique(np.column_stack((ids, labels, vectors))[~asks], axis=0, return_index=True)[1]
        ask = np.flatnonzero(asks)
        rows = wide(vectors, width)
        self.ids, self.labels, self.rows = ids[~asks][keep], labels[~asks][keep], rows[~asks][keep]
        self.ask_ids, self.ask_labels, self.ask_rows = ids[asks], labels[asks], rows[asks]
        self.limits = [np.array(x or [], np.int64) for x in table["limits"].take(pa.array(ask)).to_pylist()]

    def scores(self, own: np.ndarray, rows: np.ndarray):
        """Anchor after anchor of ``own`` with its scores of ``rows``."""
        part = self.rows[rows].T
        for s in range(0, len(own), STRIP):
            some = own[s:s + STRIP]
            yield from zip(some, long(self.ask_rows[some] @ part))


def spread(rows: DataFrame, anchors: DataFrame, block_rows: int, part_rows: int) -> DataFrame:
    """Every anchor with every block of rows, dealt by hashes of the ids."""
    blocks = max(1, math.ceil(rows.count() / block_rows))
    parts = max(1, math.ceil(anchors.count() / part_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal, columns = F.xxhash64("id"), ["id", "label", F.size("vec").alias("width"), "vec"]
    return rows.select(*columns, F.lit(None).cast(LIMITS).alias("limits"), F.pmod(deal, F.lit(blocks)).alias("block"),
                       every(parts).alias("part"), F.lit(False).alias("asks")).unionByName(
        anchors.select(*columns, "limits", every(blocks).alias("block"), F.pmod(deal, F.lit(parts)).alias("part"),
                       F.lit(True).alias("asks"))).groupBy("block", "part", "width")


def finite_integers(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``vec``: floor(scale * x) of rows with id, label, and a vector of finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & finite & (F.size(v) > 0))
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vec")))


def best_positives(rows: DataFrame, anchors: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
                   part_rows: int = PART_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``positive_score``: the k best rows with an anchor's label, itself left out."""
    def search(table: pa.Table) -> pa.Table:
        b, found = Block(table), []
        for label in np.unique(b.ask_labels):
            of = np.flatnonzero(b.labels == label)
            for a, score in b.scores(np.flatnonzero(b.ask_labels == label), of):
                other = np.flatnonzero(b.ids[of] != b.ask_ids[a])
                at = other[best(score[other], k)]
                found.append((np.full(len(at), b.ask_ids[a]), b.ids[of[at]], score[at]))
        cat = lambda i: np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]])
        return pa.table({"anchor_id": cat(0), "positive_id": cat(1), "positive_score": cat(2)})

    found = spread(rows, anchors.withColumn("limits", F.lit(None).cast(LIMITS)), block_rows, part_rows).applyInArrow(
        search, "anchor_id long, positive_id long, positive_score long").distinct()
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def share(score: Column, percent: int) -> Column:
    """``percent`` hundredths of a score, exactly."""
    return score.cast("decimal(19,0)") * F.lit(percent) / 100


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Hard negatives of frames of ``id long``, ``label long``, ``vec array<long>``; anchors are some of the rows.

    A row's score is its integer inner product with the anchor; higher comes first,
    ties go to the smaller id.  An anchor has its ``positives`` best other rows of its
    label (all, if fewer).  For each anchor and positive: the ``negatives`` best rows
    of other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive's (both included), as ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score``.  A negative score of a
    positive has an empty window.  Vectors of different lengths don't meet.  Rows that
    repeat id, label and vector count once.  Scores beyond 64 bits are cut to that
    range.  Empty tables give an empty result; other columns are not read.

    Every anchor meets every block of rows, a stated query set against all rows:
    blocks and parts of bounded size, dealt by a hash of the id, so a label or copies
    that hold a third of the rows spread evenly.  A task returns ``positives`` rows, or
    ``negatives`` rows a slot, of each anchor.
    """
    if not 0 <= low < high:
        raise ValueError("0 <= low < high")
    found = staged(best_positives(rows, anchors, positives, block_rows, part_rows), "positives")
    windows = found.where("positive_score >= 0").withColumns({
        "upper": F.floor(share(F.col("positive_score"), high)).cast("long"),
        "lower": F.ceil(share(F.col("positive_score"), low)).cast("long")})
    limits = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"),
                                              F.min("lower").alias("least"))
    asking = staged(anchors.dropDuplicates(["id", "label", "vec"]).join(limits, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "vec", F.concat(F.array("least"), "uppers").alias("limits")), "anchors")

    def search(table: pa.Table) -> pa.Table:
        b, out = Block(table), []
        for label in np.unique(b.ask_labels):
            of = np.flatnonzero(b.labels != label)
            for a, score in b.scores(np.flatnonzero(b.ask_labels == label), of):
                least, upper = b.limits[a][0], b.limits[a][1:]
                some = np.flatnonzero((score >= least) & (score <= upper[0]) & (b.ids[of] != b.ask_ids[a]))
                for j, at in by_slots(score[some], upper, negatives):
                    at = some[at]
                    out.append((np.full(len(at), b.ask_ids[a]), np.full(len(at), j), b.ids[of[at]], score[at]))
        cat = lambda i: np.concatenate([np.zeros(0, np.int64), *[f[i] for f in out]])
        return pa.table({"anchor_id": cat(0), "slot": cat(1), "vec_id": cat(2), "score": cat(3)})

    kept = spread(rows, asking, block_rows, part_rows).applyInArrow(
        search, "anchor_id long, slot long, vec_id long, score long").distinct()
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    kept = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= negatives)
    # at most `positives` slots of `negatives` rows for each anchor
    slots = kept.groupBy("anchor_id").agg(F.collect_list(F.struct(
        F.col("slot"), (-F.col("score")).alias("minus"), F.col("vec_id").alias("id"))).alias("found"))
    both = windows.join(limits.select("anchor_id", "uppers"), "anchor_id").join(slots, "anchor_id")

    def merged(found: Column, uppers: Column) -> Column:
        """Best of every slot and all below it, from the lowest slot to the highest."""
        row = "array<array<struct<minus:bigint,id:bigint>>>"

        def step(done, j):
            own = F.transform(F.filter(found, lambda x: x["slot"] == j), lambda x: F.struct(x["minus"].alias("minus"), x["id"].alias("id")))
            below = F.coalesce(F.try_element_at(done, F.lit(-1)), F.array().cast("array<struct<minus:bigint,id:bigint>>"))
            return F.concat(done, F.array(F.slice(F.array_sort(F.concat(below, own)), 1, negatives)))

        return F.aggregate(F.sequence(F.size(uppers) - 1, F.lit(0), F.lit(-1)), F.array().cast(row), step)

    slot = F.array_position("uppers", F.col("upper")).cast("int")  # from 1
    ready = both.select("anchor_id", "positive_id", "positive_score", "lower", F.element_at(
        merged(F.col("found"), F.col("uppers")), F.size("uppers") - slot + 1).alias("below"))
    return ready.select("anchor_id", "positive_id", "positive_score", F.posexplode(
        F.filter("below", lambda x: -x["minus"] >= F.col("lower"))).alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", (-F.col("n.minus")).alias("negative_score"))
