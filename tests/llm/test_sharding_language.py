"""Operators 6 and 9."""

import zlib
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from vellum.llm import queries
from vellum.llm.language_id import fit_language_model, identify_languages
from vellum.llm.sharding import communication_matrix, hypergeometric, shuffle_to_shards

from .conftest import documents


def shards_are_exact(rows, shards):
    slots = {s: [] for s in range(shards)}
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_matrix_sums():
    m = np.array(communication_matrix([5, 0, 7, 100], [28, 28, 28, 28], 1))
    assert m.sum(axis=1).tolist() == [5, 0, 7, 100] and m.sum(axis=0).tolist() == [28] * 4


def test_hypergeometric_is_exact_in_distribution():
    rng = np.random.default_rng(5)
    got = Counter(hypergeometric(rng, 4, 6, 5) for _ in range(20_000))
    from math import comb
    for k in range(5):
        assert abs(got[k] / 20_000 - comb(4, k) * comb(6, 5 - k) / comb(10, 5)) < 0.02
    assert 4.9e10 < hypergeometric(rng, 10**11, 10**11, 10**11) < 5.1e10


def test_shuffle(spark, odd_rows):
    df = documents(spark, odd_rows).select("doc_id", "text", "a")
    for cell_rows in (10, 2_000_000):  # several cells a shard, and one
        rows = shuffle_to_shards(df, "doc_id", 4, cell_rows=cell_rows).collect()
        shards_are_exact(rows, 4)
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(odd_rows)
    again = shuffle_to_shards(df.repartition(2), "doc_id", 4, cell_rows=10)
    assert Counter(map(tuple, again.collect())) == Counter(
        map(tuple, shuffle_to_shards(df, "doc_id", 4, cell_rows=10).collect()))
    assert shuffle_to_shards(df.limit(0), "doc_id", 4).count() == 0


def test_shuffle_is_uniform(spark):
    rows = shuffle_to_shards(spark.range(40_000), "id", 8).collect()
    at = np.array([[r.id, r.shard, r.slot] for r in rows], float)
    for half in (at[:, 0] < 20_000, at[:, 0] % 2 == 0):
        share = np.bincount(at[half, 1].astype(int), minlength=8) / 20_000
        assert abs(share - 1 / 8).max() < 0.015
    assert abs(np.corrcoef(at.T)[0, 1:]).max() < 0.02


def test_sharding_query(spark):
    rows = queries.op6_sharding(spark, SF_SMALL).collect()
    shards_are_exact(rows, 40)
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and len(rows) == len(docs)


def test_language_edge_cases(spark, odd_rows):
    rows = [(i, t, "en" if i and i % 2 else "xx") for i, t in odd_rows]
    df = documents(spark, rows)
    got = identify_languages(df, fit_language_model(df)).collect()
    assert len(got) == len(rows)
    letterless = {i for i, t, _ in rows if not any(c.isalpha() for c in t or "")}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in letterless)
    untaught = fit_language_model(documents(spark, [(1, "abc", None), (2, None, "en")]))
    assert {r.lang_pred for r in identify_languages(df, untaught).collect()} == {"und"}
    assert identify_languages(documents(spark, []), untaught).count() == 0


def test_mixtures_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    text = {r.lang: r.text for r in docs.where("length(text) between 1500 and 2500").collect()}
    mixed = documents(spark, [(1, text["en"] + " " + text["de"]), (2, text["fr"])])
    model = fit_language_model(docs)
    sets = {r.doc_id: r for r in identify_languages(mixed, model).collect()}
    assert set(sets[1].languages) == {"en", "de"} and sets[1].score < 0.8
    assert sets[2].languages == ["fr"] and sets[2].score == 1


def plain_mixture(like, weight, rounds=10):
    """One document's proportions by EM in plain loops, and languages taken out while the penalised likelihood rises."""
    n, k = like.shape
    total = weight.sum()

    def fit(pi):
        for _ in range(rounds):
            new = np.zeros(k)
            for w in range(n):
                joint = np.exp(like[w] - like[w].max()) * pi
                new += weight[w] * joint / joint.sum()
            pi = new / total
        return pi, sum(weight[w] * (np.log((np.exp(like[w] - like[w].max()) * pi).sum()) + like[w].max()) for w in range(n))

    def penalty(size):
        return 0.5 * (size - 1) * np.log(total + 1)

    active = set(range(k))
    pi, score = fit(np.full(k, 1 / k))
    score -= penalty(k)
    while len(active) > 1:
        weakest, best = min(active, key=lambda j: (pi[j], j)), int(np.argmax(pi))
        less = {j for j in active if pi[j] * total >= 1 and j != weakest} | {best}
        new = np.array([pi[j] if j in less else 0.0 for j in range(k)])
        new /= new.sum()
        new, value = fit(new) if len(less) > 1 else (new, float((like[:, best] * weight).sum()))
        value -= penalty(len(less))
        if value < score:
            break
        active, pi, score = less, new, value
    return np.array([pi[j] if j in active else 0.0 for j in range(k)])


def test_mixtures_equal_plain_em():
    from vellum.llm.language_id import mixtures

    rng = np.random.default_rng(6)
    likes, weights = [], []
    for _ in range(120):
        n, k = int(rng.integers(1, 25)), 4
        truth = rng.choice(k, size=n, p=rng.dirichlet(np.full(k, 0.4)))
        like = rng.normal(-9, 0.7, (n, k))
        like[np.arange(n), truth] += rng.uniform(0, 5)
        likes.append(like)
        weights.append(rng.integers(1, 9, n).astype(float))
    starts = np.cumsum([0, *map(len, weights)])[:-1]
    got = mixtures(np.concatenate(likes), np.concatenate(weights), starts)
    sizes = set()
    for row, like, weight in zip(got, likes, weights):
        want = plain_mixture(like, weight)
        assert ((row > 0) == (want > 0)).all() and np.abs(row - want).max() < 1e-9
        sizes.add(int((row > 0).sum()))
    assert len(sizes) >= 3  # one language, and mixtures of several
