"""Operators 11 and 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from llm.conftest import documents
from pyspark.sql import functions as F

from vellum.llm import queries
from vellum.llm.quality_rules import (BASE, MEASURES, POLICIES, RULES, Policy, ablations, ledger, mask, patterns, policy_counts,
                                      profile, verdicts)
from vellum.llm.run_detection import maximal_runs, numbered, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lines, bullets, ellipses, repeats and characters at the edges of the classes.
LINES = ["- a b c\n- a b c\n- d\n* e\n- a b c", "one two...\nthree…\n four... \nfive", "x y z\nx y z\r\nx y z\n\nx y z",
         "a b c d e f a b c d e", "a a a a a a", "a b c d e", "ä b  c\x85d", "#*$%&|<> ok", "!!! ??? ... ,,,",
         "a b c d e\x0bf a b c d e f g", "\n\n\n", "漢字" * 40 + " x", "i " * 30, "p q r s t u " * 3 + "end"]


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(re.findall(r"[!-/:-@\[-`{-~]", t)), len(lines), sum(x[0] in "-*•" for x in bare),
            sum(x.endswith(("...", "…")) for x in bare))


def brute_failed(m):
    n, chars, sym, dup, rep, punct, lines, bullets, ellipses = m
    fails = [n < 10, 100 * rep > 20 * n, 10 * sym > n, dup >= 3 and 10 * dup > 3 * lines, 2 * chars < 5 * n, chars > 12 * n,
             100 * punct > 20 * chars, lines >= 3 and 10 * bullets > 9 * lines, lines >= 3 and 10 * ellipses > 3 * lines]
    return sum(1 << i for i, f in enumerate(fails) if f)


def odd_texts(odd_rows):
    return odd_rows + [(20_000 + i, t) for i, t in enumerate(LINES)]


def test_ledger_equals_brute_force(spark, odd_rows):
    rows = odd_texts(odd_rows)
    book = ledger(documents(spark, rows), keep=("id", "block"))
    assert book.columns == ["doc_id", "id", "block", *MEASURES, "failed", "rules_version"]
    got = Counter((r.doc_id, *[r[m] for m in MEASURES], r.failed) for r in book.collect())
    assert got == Counter((i, *(m := brute_measures(t)), brute_failed(m)) for i, t in rows)
    assert ledger(documents(spark, [])).count() == 0


def test_policies_and_ablations(spark):
    r = random.Random(5)
    bits = [r.randrange(1 << len(RULES)) if r.random() < .7 else 0 for _ in range(800)]
    book = spark.createDataFrame([(i, f, 1, i % 3) for i, f in enumerate(bits)], "doc_id long, failed long, rules_version int, g int")
    own = Policy("own", 3, ("symbols",), ("few_words", "bullets", "ellipses"), 1)

    def rejects(p, f):
        return bool(f & mask(p.any_of)) or bool(p.several_of) and (f & mask(p.several_of)).bit_count() > p.allowed

    for p in (*POLICIES.values(), own):
        assert {x.doc_id: x.kept for x in verdicts(book, p).collect()} == {i: not rejects(p, f) for i, f in enumerate(bits)}
        got = {x.rule: (x.n, x.n_failed, x.n_alone, x.n_kept_without) for x in ablations(book, p).collect()}
        used = mask((*p.any_of, *p.several_of))
        assert got == {q.name: (len(bits), sum(f >> q.bit & 1 for f in bits),
                                sum(f & used == 1 << q.bit and rejects(p, f) for f in bits),
                                sum(not rejects(p.without(q.name), f) for f in bits))
                       for q in RULES if q.name in (*p.any_of, *p.several_of)}
    got = {(x.g, x.policy, x.version): (x.n, x.n_kept) for x in policy_counts(book, (own, POLICIES["web"]), ("g",)).collect()}
    assert got == {(g, p.name, p.version): (len(bits[g::3]), sum(not rejects(p, f) for f in bits[g::3]))
                   for g in range(3) for p in (own, POLICIES["web"])}
    assert sum(x.n for x in patterns(book).collect()) == len(bits)
    some = profile(book, ("g",)).collect()
    assert {x.g: (x.any_failed, x.all_failed) for x in some} == {
        g: (int(np.bitwise_or.reduce(bits[g::3])), int(np.bitwise_and.reduce(bits[g::3]))) for g in range(3)}
    empty = book.where("false")
    assert ablations(empty, own).count() == 0 and verdicts(empty, own).count() == 0


def test_policies_refuse_other_rules(spark):
    book = spark.createDataFrame([(1, 0, 2)], "doc_id long, failed long, rules_version int")
    with pytest.raises(Exception, match="wants rules version 1"):
        verdicts(book, POLICIES["web"]).collect()
    with pytest.raises(KeyError):
        Policy("typo", 1, ("few_word",)).rejects(F.col("failed"))


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op11_quality_rules(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        m = brute_measures(texts[r.doc_id])
        failed = brute_failed(m)
        assert tuple(r[1:6]) == m[:5] and r.failed == failed
        assert r.base_failed == bool(failed & mask(BASE)) == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.kept and r.base_failed)


def test_quality_keeps_what_is_labelled_good(spark):
    d = "/root/testdata/sf0.01"
    kept = queries.op11_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.s for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05


def brute_runs(words, exponent=4, least=6):
    """Start, period and length of the runs, period by period."""
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, exponent * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, q, n) for (s, n), q in out.items())


@pytest.mark.parametrize("exponent, least", [(2, 2), (3, 6), (4, 6)])
def test_runs_equal_brute_force(exponent, least):
    r = random.Random(exponent)
    for trial in range(1500):
        docs = [[r.choice("abc"[:r.choice([1, 2, 2, 3])]) for _ in range(r.randrange(45))] for _ in range(r.randrange(1, 5))]
        if trial % 3 == 0:
            docs = [(d[:r.randrange(1, 7)] or ["x"]) * r.randrange(1, 9) + d for d in docs]
        symbols, first = numbered(docs)
        start, length, period = maximal_runs(symbols, exponent, least)
        of = np.searchsorted(first, start, side="right") - 1
        got = [[] for _ in docs]
        for d, s, n, q in zip(of, start, length, period):
            got[d].append((s - first[d], q, n))
        assert got == [brute_runs(d, exponent, least) for d in docs]


def test_long_runs_are_quick():
    for words, n in ((["a"] * 300_000, 1), ([str(i) for i in range(1000)] * 300, 1), (["a", "b"] * 100_000 + ["c"] * 100_000, 2)):
        assert len(maximal_runs(numbered([words])[0])[0]) == n


def brute_document(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = None
    for s, q, k in runs:
        if best is None or k * best[1] > best[2] * q:
            best = (s, q, k)
    gone = {i for s, q, k in runs for i in range(s + q, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *row, sha("".join(f"{s},{k},{q}\n" for s, q, k in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_run_detection(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(brute_document(*d) for d in docs)
    assert sum(r[1] > 0 for r in rows) >= 5


def test_runs_of_odd_documents(spark, odd_rows):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 100_000]
    rows += [(30_000, "x a b a b a b a b y"), (30_001, "a b " * 5 + "a"), (30_002, "k " * 6), (30_003, "k " * 5), (30_004, "u v w " * 3 + "u v")]
    got = periodic_runs(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.period, x.length) for x in r.runs)) for r in got) == Counter(
        (i, len(w := WORD.findall(t or "")), tuple(brute_runs(w))) for i, t in rows)
    kept = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert kept[30_000] == "x a b y" and kept[30_001] == "a b" and kept[30_002] == "k" and kept[30_004] == "u v w " * 3 + "u v"
    long = [r for r in odd_rows if r[1] is not None and len(r[1]) >= 100_000]
    assert [(r.n_words, len(r.runs)) for r in periodic_runs(documents(spark, long)).collect()] == [(120_000, 0)] * len(long)
    assert periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(documents(spark, []), exponent=1)
