"""Operators 1 and 10 against brute force."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import types as T

from vellum.llm import queries
from vellum.llm.near_dup_vectors import near_duplicate_vectors, reaches
from vellum.llm.topk_search import exact_top_k, quantized

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("id", T.StringType()), T.StructField("vec", T.StringType()),
                       T.StructField("rep", T.StringType()), T.StructField("block", T.StringType())])


def frame(spark, rows, partitions=3):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c", "d") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def odd_vectors(seed=1, n=260, width=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(int(i * 2), base[i].tolist()) for i in range(n)]
    rows += [(1001 + 2 * i, (base[i % 20] + rng.normal(size=width) * 0.12).astype(np.float32).tolist()) for i in range(120)]
    rows += [(3001 + 2 * i, base[3].tolist()) for i in range(25)]  # copies
    rows += [(4001 + 2 * i, (base[4] * np.float32(2 ** i)).tolist()) for i in range(6)]  # the same direction
    chain = [np.cos(0.2 * i) * base[0] / np.linalg.norm(base[0]) + np.sin(0.2 * i) * np.eye(width)[0] for i in range(9)]
    rows += [(5001 + 2 * i, v.astype(np.float32).tolist()) for i, v in enumerate(chain)]
    rows += [(6001, None), (6003, []), (6005, [0.0] * width), (6007, [None] + [1.0] * (width - 1)),
             (6009, [float("nan")] * width), (6011, [float("inf")] + [0.0] * (width - 1)), (6013, [1.0, 2.0]),
             (6015, [1.0, 2.0]), (None, base[3].tolist()), (6020, [1e-30] * width), (6022, [1e30] * width), (6024, [-0.0] * (width - 1) + [1.0])]
    return rows


def usable(v, zero_ok=False):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v))


def brute_links(rows, threshold=0.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and usable(v)]
    link = {i: set() for i, _ in rows if i is not None}
    for a, x in ok:
        for b, y in ok:
            if a < b and len(x) == len(y):
                p, q = x / np.abs(x).max(), y / np.abs(y).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                    link[a].add(b)
                    link[b].add(a)
    out = {}
    for i in sorted(link):
        if i not in out:
            todo = [i]
            out[i] = i
            while todo:
                for j in link[todo.pop()]:
                    if j not in out:
                        out[j] = i
                        todo.append(j)
    return {i: (len(link[i]), out[i], out[i] == i) for i in link}


@pytest.mark.parametrize("tile", [40, 4096])
def test_near_duplicates_equal_brute_force(spark, tile):
    rows = odd_vectors()
    got = near_duplicate_vectors(frame(spark, rows), tile=tile).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute_links(rows)
    none = [r for r in got if r.vec_id is None]
    assert [(r.n_links, r.component_id, r.kept) for r in none] == [(0, None, False)]


def test_near_duplicates_dense_group_and_empty_table(spark):
    rng = np.random.default_rng(3)
    core = rng.normal(size=16)
    rows = [(i, (core + rng.normal(size=16) * (0.05 if i % 3 else 3)).astype(np.float32).tolist()) for i in range(700)]
    got = near_duplicate_vectors(frame(spark, rows), tile=256).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows)
    assert near_duplicate_vectors(frame(spark, [])).count() == 0
    assert near_duplicate_vectors(frame(spark, [(1, None), (2, [0.0])])).count() == 2


def brute_top(rows, k, step=20):
    ok = sorted({(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows
                 if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and max(map(abs, v), default=0) < 1e9})
    out = []
    for i, q in ok:
        if i % step == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(30, 7), (16384, 1024)])
def test_top_k_equals_brute_force(spark, blocks):
    rows = [r for r in odd_vectors() if r[0] != 6022] + [(40, None), (7000, [0.0] * 12), (7020, [1.0, 2.0])]
    rows += [rows[5], rows[10]]  # repeated rows count once
    rows = [r for r in rows if not (r[0] == 40 and r[1] is None)]
    v = quantized(frame(spark, rows), "vec_id", "embedding", 64)
    got = exact_top_k(v.where("id % 20 = 0"), v, 20, *blocks).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)


def test_top_k_small_and_empty(spark):
    v = quantized(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), "vec_id", "embedding", 64)
    got = exact_top_k(v.where("id = 0"), v, 20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]
    e = quantized(frame(spark, []), "vec_id", "embedding", 64)
    assert exact_top_k(e, e, 20).count() == 0


def test_queries(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = queries.op1_near_dup_vectors(spark, SF_SMALL).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows)
    assert sorted(map(tuple, queries.op10_topk_search(spark, SF_SMALL).collect())) == brute_top(rows, 20)


def test_reaches_equal_all_pairs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 60):
        cuts = np.sort(rng.normal(size=n).round(1))
        low, high = [-np.inf, *cuts], [*cuts, np.inf]
        for reach in (0.0, 0.13, 9.0):
            _, far, near = reaches(cuts, reach)
            want = [max(u for u in range(n + 1) if u == t or low[u] <= high[t] + reach) for t in range(n + 1)]
            assert far.tolist() == want and near.tolist() == [min(t for t in range(n + 1) if want[t] >= u) for u in range(n + 1)]
