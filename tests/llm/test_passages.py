"""Operators 2, 4 and 7 and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from vellum.llm import queries
from vellum.llm.jaccard_join import Bands, bitmap, fold, jaccard_classes, overlap_bound, shingle_sets, similar, tile_keys
from vellum.llm.passages import shards
from vellum.llm.substring_dedup import FMIndex, remove_repeated_windows
from vellum.llm.suffix_dedup import content_shards, judged, remove_repeated_bytes, repeated
from vellum.llm.words import Words

from .conftest import documents
from .test_tokens import check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_classes(rows, k, percent):
    sets = brute_sets(rows, k)
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            m, n = sets[a], sets[b]
            if m and n and 100 * len(m & n) >= percent * len(m | n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_windows(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    low = {}
    for i in sorted(k for k in words if k is not None):
        for j in range(len(words[i]) - window + 1):
            low.setdefault(tuple(words[i][j:j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and low[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def brute_bytes(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    count = Counter(d[j:j + length] for i, d in data.items() if i is not None for j in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        stay = np.ones(len(d) + 1, bool)
        for j in range(len(d) - length + 1):
            if i is not None and count[d[j:j + length]] > 1:
                stay[j:j + length] = False
        spans = int((np.diff(np.append(True, stay).astype(int)) == -1).sum())
        out[i] = (len(d), int((~stay[:-1]).sum()), spans, bytes(x for x, s in zip(d, stay) if s))
    return out


def corpus(seed=11):
    """Near copies, chains of them, shared passages, periodic texts, lines repeated within a text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    draw = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = []
    for n in (3, 4, 20, 80, 250):
        w = draw(n)
        texts += [" ".join(w)] * 2
        for _ in range(12):
            w = list(w)
            for _ in range(max(1, n // 60)):
                w[r.randrange(n)] = r.choice(vocab)
            texts.append((" ", "\n", "  ")[r.randrange(3)].join(w).capitalize())
    passage, line = draw(30), " ".join(draw(14))
    for i in range(40):
        at = r.randrange(30)
        texts.append(" ".join(draw(60) + passage[at // 3:] + draw(40)))
        texts.append("\n".join([line] * r.randint(1, 8) + draw(5)))
    texts += ["xy" * 400, "xy " * 500, "z" * 1000, " ".join(["w"] * 60)] + [None, "", " \n", "one", "One", "one two"]
    r.shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, texts[5])]


ROWS = corpus()


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_classes(spark, k, percent):
    got = jaccard_classes(documents(spark, ROWS + [ROWS[3], ROWS[7]]), k, percent).collect()
    assert len(got) == len(ROWS) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_classes(ROWS, k, percent)
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert jaccard_classes(documents(spark, [])).count() == 0


@given(st.integers(1, 500), st.integers(0, 120), st.integers(0, 120), st.integers(50, 95), st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_tile(n, changed, added, percent, seed):
    rng = np.random.default_rng(seed)
    bands = Bands(percent)
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    b = a.copy()
    b[:min(n, changed)] = rng.integers(0, 2**63, min(n, changed), dtype=np.uint64)
    a, b = np.unique(a), np.unique(np.append(b, rng.integers(0, 2**63, added, dtype=np.uint64)))
    x, y = bitmap(a), bitmap(b)
    width = min(len(x), len(y))
    both = len(np.intersect1d(a, b))
    assert overlap_bound(fold(x[None], width), len(a), fold(y[None], width), len(b))[0] >= both
    assert similar(a, b, percent) == (100 * both >= percent * (len(a) + len(b) - both))
    if similar(a, b, percent):
        assert len(np.intersect1d(tile_keys(a, bands), tile_keys(b, bands)))


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_share_no_tile(percent):
    rng, bands = np.random.default_rng(3), Bands(percent)
    for n in (*range(1, 30), 60):
        keys = [np.unique(tile_keys(np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)), bands)) for _ in range(400)]
        assert all(len(k) for k in keys)
        assert np.unique(np.concatenate(keys), return_counts=True)[1].max() == 1, n


def test_small_sets_in_one_part_still_meet():
    rng, bands = np.random.default_rng(4), Bands(80)
    base = rng.integers(0, 2**60, 24, dtype=np.uint64)  # all in the first part of any cut of the hash range
    for n in range(5, 25):
        a, b = np.sort(base[:n]), np.sort(base[1:n])
        if similar(a, b, 80):
            assert len(np.intersect1d(tile_keys(a, bands), tile_keys(b, bands))), n


def test_words_equal_the_pattern(odd_rows):
    texts = [t for _, t in odd_rows] + ["A\x0bB\x0cC", "x" * 500 + " y", "   ", "ÀÉ Z"]
    w = Words(texts, lower=True)
    expect = [WORD.findall(lower(t or "")) for t in texts]
    assert w.counts().tolist() == [len(x) for x in expect]
    known = {}
    for word, h in zip([x for e in expect for x in e], w.hashes.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert len(shingle_sets(["a b", "A B", "a b c d e"], 4)[2]) == 2


@pytest.mark.parametrize("window", [13, 6])
def test_repeated_windows(spark, window):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = remove_repeated_windows(documents(spark, ROWS + [rows[3]]), window, keep=("source", "part")).collect()
    assert len(got) == len(ROWS) + 1
    expect = brute_windows(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None} == expect
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    assert remove_repeated_windows(documents(spark, [])).count() == 0


def test_repeated_windows_of_a_hot_anchor_span_shards(spark, monkeypatch):
    import vellum.llm.substring_dedup as module
    monkeypatch.setattr(module, "SHARD_BYTES", 600)
    rows = [(i, t) for i, t in ROWS if i is not None]
    found = []
    pieces = module.repeated_fragments(documents(spark, rows).select("doc_id", "text").toDF("id", "text"),
                                       module.word_runs(13), across=True).orderBy("key", "id", "start").collect()
    table = pa.RecordBatch.from_pylist([{**p.asDict(), "data": bytes(p.data)} for p in pieces])
    earlier = []
    for shard in shards(iter([table.slice(0, 100), table.slice(100)]), 600, split=True):
        if not shard.goes_on:
            earlier = []
        batch, index = module.covered(shard, earlier, 13)
        earlier = [*earlier, index] if shard.key[-1] == shard.key[0] else [index]
        found += batch.to_pylist()
    gone = {}
    for f in found:
        gone.setdefault(f["id"], set()).update(range(f["start"], f["stop"]))
    expect = {i: n for i, (_, n, _) in brute_windows(rows, 13).items() if n}
    assert {i: len(x) for i, x in gone.items()} == expect


@pytest.mark.parametrize("length", [400, 70])
def test_repeated_bytes(spark, length):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = remove_repeated_bytes(documents(spark, ROWS + [rows[3]]), length).collect()
    assert len(got) == len(ROWS) + 1
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got
            if r.doc_id is not None} == brute_bytes(rows, length)
    assert remove_repeated_bytes(documents(spark, [])).count() == 0


def test_copies_never_reach_a_shard(spark, monkeypatch):
    from vellum.llm import suffix_dedup as module

    r = random.Random(17)
    body = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(i, body) for i in range(300)] + [(1000 + i, f"{i:03d} head" + body[:500] + f"tail {i:03d}") for i in range(40)]
    rows += [(2000, "alone " * 3 + body[::-1])]
    monkeypatch.setattr(module, "SHARD_BYTES", 2000)
    parts = []
    monkeypatch.setattr(module, "staged", lambda df, name, keep=module.staged: parts.append((name, keep(df, name))) or parts[-1][1])
    got = module.remove_repeated_bytes(documents(spark, rows + rows[:5]), 400).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got} == brute_bytes(rows, 400)
    tables = dict(parts)
    assert tables["found"].count() == tables["found"].select("key", "digest").distinct().count()
    assert tables["found"].count() < tables["fragments"].count() / 4  # a content is judged once, not for each place


def test_judged_counts_a_copied_fragment_once():
    text = b"".join(bytes([97 + i % 23]) * (i % 7 + 1) for i in range(150))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 3]), pa.array([b"a", b"b", b"c", b"d"]),
                                        pa.array([True, False, False, True]),
                                        pa.array([text[:450], text[20:480], text[:410], text[:401]])],
                                       names=["key", "digest", "several", "data"])
    assert [s[1] for s in content_shards(iter([batch]), 500)] == [[b"a", b"b"], [b"c", b"d"]]
    hit, low, high = judged(np.array([1, 1, 2, 3]), np.array([True, False, False, True]), batch["data"].to_pylist(), 400)
    assert list(zip(hit.tolist(), low.tolist(), high.tolist())) == [(0, 0, 50), (1, 0, 30), (3, 0, 1)]


@given(st.lists(st.text("ab", min_size=4, max_size=40), min_size=1, max_size=6), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_interval_expansion(pieces, window):
    data = [p.encode() for p in pieces]
    size = np.array([len(d) for d in data])
    got = repeated(np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size - window + 1, window)
    every = [d[i:i + window] for d in data for i in range(len(d) - window + 1)]
    count = Counter(every)
    assert got.tolist() == [count[w] > 1 for w in every]


@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_backward_search_counts(symbols, pattern):
    index = FMIndex(np.array([*symbols, 0]), 4)
    low, high = np.array([0]), np.array([len(symbols) + 1])
    for s in reversed(pattern):
        if s > max(symbols):
            return
        low, high = index.extend(np.array([s]), low, high)
    n = len(pattern)
    assert high[0] - low[0] == sum(symbols[i:i + n] == pattern for i in range(len(symbols) - n + 1))


def test_queries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard_join(spark, SF_SMALL).collect()}
    assert got == brute_classes(docs, 4, 85)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, SF_SMALL).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in brute_windows(docs, 13).items()}


def test_pipeline(spark):
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in base.collect()]
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    classes = brute_classes(kept, 5, 80)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    cut = brute_windows(kept, 13)
    final = [(i, t if cut[i][1] == 0 else cut[i][2]) for i, t in kept if cut[i][0] > cut[i][1]]
    stages = dict(corpus_pipeline.STAGES)
    rows = base
    for name, _ in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.staged(stages[name](spark, rows, SF_SMALL), name)
        assert rows.columns == base.columns
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == sorted(final)
    assert all(r.n_chars == len(r.text) for r in rows.collect() if cut[r.doc_id][1])
    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    check_packing(pieces, final, 1)
    assert {p.doc_id for p in pieces} == {i for i, _ in final}


def test_pipeline_stages_take_odd_rows(spark, odd_rows):
    for rows in (odd_rows, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            out.collect()
            if not rows:
                assert out.count() == 0
