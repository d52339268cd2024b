"""Operator 12 against brute force."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import types as T

from vellum.llm import queries
from vellum.llm.hard_negatives import best, by_slots, finite_integers, hard_negatives
from pyspark.sql import functions as F

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()),
                       T.StructField("vec", T.StringType()), T.StructField("block", T.StringType()),
                       T.StructField("limits", T.StringType())])


def frame(spark, rows, partitions=3):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "a", "b", "c", "d") for i, label, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def brute(rows, scale=16, anchors=5, positives=5, negatives=3, low=50, high=95):
    ok = sorted({(i, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, label, v in rows
                 if None not in (i, label, v) and len(v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, la, q in ok:
        if a % anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in ok if i != a and len(v) == len(q))
        for p, i, _ in [x for x in scored if x[2] == la][:positives]:
            hard = [x for x in scored if x[2] != la and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(hard)]
    return sorted(out)


def rows_of(n=300, width=6, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)).astype(np.float32) + 0.6
    return [(i, None if i % 41 == 0 else int(rng.integers(labels)) if i % 3 else 0, base[i].tolist()) for i in range(n)]


def odd(width=6):
    return [(1001, 1, None), (1005, 1, []), (1010, 0, [0.0] * width), (1015, 2, [None] + [1.0] * (width - 1)),
            (1020, 2, [float("nan")] * width), (1025, 2, [float("inf")] + [0.0] * (width - 1)), (1030, 1, [1.0, 2.0]),
            (1031, 1, [1.0, 2.0]), (1032, 2, [0.5, 1.0]), (1033, 2, [0.5, 1.0]), (None, 1, [1.0] * width), (1040, 1, [-9.0] * width)]


def mined(spark, rows, *sizes, **options):
    data = finite_integers(frame(spark, rows), "vec_id", F.col("label"), "embedding", 16)
    return sorted(map(tuple, hard_negatives(data, data.where("id % 5 = 0"), **options, **dict(zip(("block_rows", "part_rows"), sizes))).collect()))


@pytest.mark.parametrize("sizes", [(40, 7), (16384, 1024)])
def test_equal_brute_force(spark, sizes):
    rows = rows_of() + odd()
    rows += [rows[5], rows[10]]  # repeated rows count once
    rows += [(2000 + i, i % 3, rows[7][2]) for i in range(60)]  # copies: ties
    assert mined(spark, rows, *sizes) == brute(rows)


def test_other_limits_and_hot_label(spark):
    rows = [(i, 0 if i % 3 else 1, v) for i, _, v in rows_of(200, seed=9)]
    assert mined(spark, rows, 50, 20, positives=7, negatives=2, low=0, high=120) == brute(rows, positives=7, negatives=2, low=0, high=120)
    with pytest.raises(ValueError):
        mined(spark, rows, low=50, high=50)


def test_scores_beyond_doubles(spark):
    rows = [(i, i % 2, [float(2 ** 24 + i * 2 ** 20 + i), float(i % 5)]) for i in range(40)]
    assert mined(spark, rows, 10, 4) == brute(rows)
    assert max(r[4] for r in brute(rows)) > 2 ** 53


def test_huge_components_and_few_rows(spark):
    huge = [(i, i % 2, [1e30, 1.0]) for i in range(12)]
    assert len(mined(spark, huge)) >= 0
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.75])]) == [(0, 1, 1, 2, 256, 192)]


def test_slots_are_disjoint_and_complete():
    rng = np.random.default_rng(0)
    for _ in range(200):
        score = rng.integers(0, 12, 30)
        upper = np.unique(rng.integers(0, 14, 4))[::-1]
        got = by_slots(score[score <= upper[0]], upper, 3)
        below = score[score <= upper[0]]
        for j, at in got:
            floor = upper[j + 1] if j + 1 < len(upper) else -1
            own = np.flatnonzero((below > floor) & (below <= upper[j]))
            assert at.tolist() == sorted(own, key=lambda i: (-below[i], i))[:3]
        assert sorted(j for j, _ in got) == sorted({int((upper >= s).sum()) - 1 for s in below})
        assert best(score, 4).tolist() == sorted(range(30), key=lambda i: (-score[i], i))[:4]


def test_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = queries.op12_hard_negatives(spark, SF_SMALL)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 256, 50)
