"""Operator 10, exact top-k search by Fagin's threshold algorithm.

Candidates are dealt into blocks.  A block sorts its candidates once for each
dimension; a query reads all lists in step, each from the end that its own sign
favours, and scores every candidate that it meets.  The best score that an
unseen candidate may still have is the query's product with the values at the
current depth; once that is below the k-th score, the block is finished.  A
block returns its k best for each query, and a window keeps the k best of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a candidate block and of a query block: the memory bound of a task.
CANDIDATES = 16384
QUERIES = 1024
FIRST_DEPTH = 1024


class SortedLists:
    """The candidates of a block, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]  # in order of ids, so ties fall to the smaller
        up = np.argsort(self.vectors, axis=0).T.astype(np.int32)
        self.lists = np.stack((up, up[:, ::-1]))  # ascending and descending

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than ``query_id``."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        weight = query[dims]
        downward = (weight > 0).astype(np.int8)
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, query_id):np.searchsorted(self.ids, query_id, side="right")] = True
        best, score = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            if len(dims):
                rows = self.lists[downward, dims, depth:end]
                met = np.zeros(n, bool)
                met[rows.ravel()] = True
                fresh = np.flatnonzero(met & ~seen)
                bound = (self.vectors[rows[:, -1], dims] * weight).sum()
            else:  # a query of zeros scores all alike
                fresh, end, bound = np.flatnonzero(~seen), n, 0
            seen[fresh] = True
            best = np.concatenate((best, fresh))
            # most of the block at once is quicker to score in place than to copy out
            got = (self.vectors @ query)[fresh] if 4 * len(fresh) > n else self.vectors[fresh] @ query
            score = np.concatenate((score, got))
            if len(best) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= kth
                best, score = best[keep], score[keep]
                order = np.lexsort((best, -score))[:k]
                best, score = best[order], score[order]  # ties with the k-th beyond k have larger ids
            if len(best) >= k and score[k - 1] > bound:
                break
            depth, step = end, 2 * step
        order = np.lexsort((best, -score))
        return self.ids[best[order]], score[order]


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``vec``: floor(scale * x) of the vectors whose components are all finite.

    Rows with a null id, a null vector or a component that is null or not finite are left
    out; repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vec")))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int = CANDIDATES,
                query_rows: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for frames of ``id long``, ``vec array<long>``.

    Score is the integer inner product, ties go to the smaller id; a candidate
    with the query's own id is left out.  Vectors of different lengths don't
    meet.  Rows that repeat id and vector count once.  Every query meets every
    candidate block, in blocks of bounded size dealt by a hash of the id, so
    copies and hot labels spread evenly.  Empty tables give an empty result.
    """
    blocks = max(1, math.ceil(candidates.count() / block_rows))
    parts = max(1, math.ceil(queries.count() / query_rows))
    spread = F.xxhash64("id")
    place = [F.size("vec").alias("width"), "id", "vec"]
    c = candidates.select(*place, F.pmod(spread, F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(False).alias("asks"))
    q = queries.select(*place, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                       F.pmod(spread, F.lit(parts)).alias("part"), F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        width = table["width"][0].as_py()
        ids = table["id"].to_numpy()
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), width)
        if width * float(np.abs(flat).max(initial=0)) ** 2 < 2 ** 52:
            vectors = vectors.astype(np.float64)  # products and sums are exact whole numbers
        asks = table["asks"].to_numpy(zero_copy_only=False)
        rows = np.column_stack((ids[~asks], vectors[~asks].astype(np.int64)))
        keep = np.unique(rows, axis=0, return_index=True)[1]
        lists = SortedLists(ids[~asks][keep], vectors[~asks][keep])
        found = [(i, *lists.top(i, v, k)) for i, v in zip(ids[asks], vectors[asks])] if len(keep) else []
        n = [len(f[1]) for f in found]
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": np.repeat(np.array([f[0] for f in found], np.int64), n),
                         "vec_id": cat([f[1] for f in found]), "score": cat([f[2] for f in found])})

    found = c.unionByName(q).groupBy("block", "part", "width").applyInArrow(
        search, "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
