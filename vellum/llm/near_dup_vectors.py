"""Operator 1, embedding near-deduplication by PCA-ordered tiled comparison.

Unit vectors are rotated into the eigenvectors of their second moments, most
energy first, and sorted into tiles along the leading coordinate.  Two tiles
meet only if their ranges are near enough for a link.  A pair of tiles
accumulates products over the leading coordinates; Cauchy-Schwarz bounds the
rest by the norms of the suffixes, and a pair stops as soon as its bound is
below the threshold.  What is left at the end is judged by its cosine in double
precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vellum.llm.common import components, staged

#: Rows of a tile, and of the strip that a task compares with a tile at once.
TILE = 4096
STRIP = 512
#: Coordinates accumulated between two looks at the bound.
STEP = 8
#: More than the error that rounding may put into a product of unit vectors.
SLACK = 1e-9
PAIRS = 1 << 16


def units(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length in double precision, and the same scaled to length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return v, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Eigenvectors of the second moments of all unit vectors, by length; width x width numbers reach the driver."""
    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            width = pa.compute.list_value_length(b["vec"])
            for w in pa.compute.unique(width).to_pylist():
                u = units(b["vec"].filter(pa.compute.equal(width, w)))[1]
                sums[w] = sums.get(w, 0) + u.T @ u
        for w, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()),
                                              pa.array(list(m))], names=["width", "i", "row"])

    rows = (vectors.select("vec").mapInArrow(moments, "width int, i int, row array<double>")
            .select("width", "i", F.posexplode("row").alias("j", "x")).groupBy("width", "i", "j").agg(F.sum("x").alias("x")).toPandas())
    out = {}
    for w, part in rows.groupby("width"):
        m = np.zeros((w, w))
        m[part["i"], part["j"]] = part["x"]
        out[int(w)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


def links(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, threshold: float, same: bool):
    """Pairs of rows with cosine of at least ``threshold``, strip by strip: arrays of places in a and in b."""
    width = a.shape[1]
    stops = [*range(STEP, width, STEP), width]
    rest_a = np.sqrt(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1])
    rest_b = np.sqrt(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1])
    norm_a, norm_b = np.sqrt((va * va).sum(axis=1)), np.sqrt((vb * vb).sum(axis=1))

    def judged(i, j):
        out = []
        for s in range(0, len(i), PAIRS):
            x, y = i[s:s + PAIRS], j[s:s + PAIRS]
            out.append(np.einsum("ij,ij->i", va[x], vb[y]) / (norm_a[x] * norm_b[y]) >= threshold)
        return np.concatenate(out) if out else np.zeros(0, bool)

    for s in range(0, len(a), STRIP):
        e, top = min(s + STRIP, len(a)), stops[0]
        first = s if same else 0
        part = a[s:e, :top] @ b[first:, :top].T
        bound = part + np.outer(rest_a[s:e, top], rest_b[first:, top]) if top < width else part
        live = bound >= threshold - SLACK
        if same:
            live &= np.arange(first, len(b))[None, :] > np.arange(s, e)[:, None]
        i, j = np.nonzero(live)
        if len(i) * 4 > live.size:  # a strip full of near copies: products of whole rows are cheaper
            value = a[s:e] @ b[first:].T
            sure = live & (value >= threshold + SLACK)
            i, j = np.nonzero(sure)
            yield i + s, j + first
            i, j = np.nonzero(live & ~sure & (value >= threshold - SLACK))
            i, j = i + s, j + first
            ok = judged(i, j)
            yield i[ok], j[ok]
            continue
        acc = part[i, j]
        i, j = i + s, j + first
        for low, high in zip(stops, stops[1:]):
            keep = np.zeros(len(i), bool)
            for p in range(0, len(i), PAIRS):
                x, y = i[p:p + PAIRS], j[p:p + PAIRS]
                acc[p:p + PAIRS] += np.einsum("ij,ij->i", a[x, low:high], b[y, low:high])
                rest = rest_a[x, high] * rest_b[y, high] if high < width else 0
                keep[p:p + PAIRS] = acc[p:p + PAIRS] + rest >= threshold - SLACK
            i, j, acc = i[keep], j[keep], acc[keep]
        ok = judged(i, j)
        yield i[ok], j[ok]


def forest(n: int, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place that is reached) of n places after adding links i - j."""
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return label
        for end in (i, j):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]


def reaches(cuts: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cuts between tiles; the last tile that each tile has to meet, and the first that has to meet it."""
    low, high = np.concatenate(([-np.inf], cuts)), np.concatenate((cuts, [np.inf]))
    own = np.arange(len(low))
    far = np.maximum(np.searchsorted(low, high + reach, side="right") - 1, own)
    return cuts, far, np.searchsorted(far, own)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` for every row.

    Two rows link if their cosine is at least ``threshold``.  A vector that is
    null, empty, zero, or holds null or non-finite components links with
    nothing, nor does a row with a null id (its component is null and it isn't
    kept); vectors of different lengths don't link.  Rows with equal vectors are
    compared once and counted each, repeated ids too.  An empty table gives an
    empty result; other columns are not read.

    Tiles have about ``tile`` rows, so a pair of tiles is a task of bounded
    memory; a row is sent to the tiles within reach of its own, and a tile pair
    returns counts and a spanning forest of its links, never the links.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, v).alias("vec"))
    copies = staged(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")),
                    "copies")
    turn = spark.sparkContext.broadcast(rotations(copies))  # one width x width matrix

    def lead(batches):
        for b in batches:
            width = np.asarray(pa.compute.list_value_length(b["vec"]))
            out = np.zeros(len(width))
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                out[at] = units(b["vec"].take(pa.array(at)))[1] @ turn.value[int(w)][:, 0]
            yield pa.RecordBatch.from_arrays([b["rep"], b["copies"], b["vec"], pa.array(out)], names=["rep", "copies", "vec", "lead"])

    kind = copies.schema["vec"].dataType.simpleString()
    # a trace of the id splits a run of equal coordinates between tiles; the reach allows for it
    placed = staged(copies.mapInArrow(lead, f"rep long, copies long, vec {kind}, lead double").withColumn(
        "lead", F.col("lead") + F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) * 1e-16), "placed")
    tiles = max(1, math.ceil(placed.count() / tile))
    cuts = placed.approxQuantile("lead", [i / tiles for i in range(1, tiles)], 0.1 / tiles) if tiles > 1 else []
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7  # links are no farther apart in any coordinate
    deal = spark.sparkContext.broadcast(reaches(np.array(cuts), reach))  # three numbers a tile

    @pandas_udf("struct<t:int,far:int,near:int>")
    def tile_of(lead: pd.Series) -> pd.DataFrame:
        cuts, far, near = deal.value
        t = np.searchsorted(cuts, lead, side="right")
        return pd.DataFrame({"t": t, "far": far[t], "near": near[t]})

    own = placed.select("rep", "copies", "vec", F.size("vec").alias("width"), tile_of("lead").alias("at")).select(
        "rep", "copies", "vec", "width", "at.t", "at.far", "at.near")
    rows_of = ["rep", "copies", "vec", "width", "t"]
    # no sequence is empty; an inner explode would make Spark look for empty ones first, with the tiles computed twice
    left = own.select(*rows_of, F.explode_outer(F.sequence("t", "far")).alias("u"), F.lit(True).alias("left"))
    right = own.select(*rows_of, F.explode_outer(F.sequence("near", "t")).alias("u"), F.lit(False).alias("left"))
    pairs = left.unionByName(right.where("u < t").select("rep", "copies", "vec", "width", F.col("u").alias("t"),
                                                         F.col("t").alias("u"), "left"))

    def compare(table: pa.Table) -> pa.Table:
        side = table["left"].to_numpy(zero_copy_only=False)
        rep, n = table["rep"].to_numpy(), table["copies"].to_numpy()
        order = np.argsort(rep, kind="stable")  # then the smallest place of a component is its smallest id
        rep, n, side, table = rep[order], n[order], side[order], table.take(pa.array(order))
        vec, unit = units(table["vec"])
        unit = unit @ turn.value[vec.shape[1]]
        same = side.all()
        a = np.flatnonzero(side)
        b = a if same else np.flatnonzero(~side)
        count, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in links(unit[a], unit[b], vec[a], vec[b], threshold, same):
            i, j = a[i], b[j]
            if len(i):
                count += np.bincount(i, n[j], len(rep)).astype(np.int64) + np.bincount(j, n[i], len(rep)).astype(np.int64)
                label = forest(len(rep), label, i, j)
        hit = np.flatnonzero(count)
        return pa.table({"rep": rep[hit], "n": count[hit], "to": rep[label[hit]]})

    found = staged(pairs.groupBy("t", "u", "width").applyInArrow(compare, "rep long, n long, to long"), "found")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    by_vector = (copies.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    return rows.join(by_vector, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
