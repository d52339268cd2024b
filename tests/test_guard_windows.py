"""E1-E3 from the ends of token lists, a user's tokenizer, and E5 batches filled by tokens."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions.guard import ends_of, head_tail, pair_budget, pieces, tokenizer_ends, tokenizer_file, whitespace_ends
from vellum.functions.text import open_delimiters, tokens, unclosed_index
from vellum.operators.guard import (VISIBILITY_FIELDS, Window, batch_classify, budget_batches, classify_by_budget, guard_pairs, padding,
                                    pair_visibility)
from vellum.plans import catalog as C

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def expected_counts(q, r, budget=124, reserve=64):
    """The five counts, in plain Python."""
    r0 = min(r, reserve, budget)
    q0 = min(q, budget - r0)
    rest = budget - r0 - q0
    more = min(max(0, r - r0), rest)
    rb = r0 + more
    qb = q0 + min(max(0, q - q0), rest - more)
    return q, min(q, qb), r, rb, min(r, rb)


def test_ends_equal_whole_lists(spark):
    r = random.Random(1)
    space = [" ", "\n", "\t  ", " ", "　", "\x1c"]
    texts = ["".join(r.choice(["a", "word", "ü", "漢字", "x1"]) + r.choice(space) for _ in range(n)) for n in (0, 1, 2, 5, 8, 9, 40, 400)]
    texts += [None, "", "  ", " lead", "trail \n", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for keep in (1, 4, 9):
        rows = df.select(whitespace_ends(F.col("t"), keep).alias("a"), ends_of(tokens("t"), keep).alias("b")).collect()
        assert all(x.a == x.b for x in rows)
    x = df.select(pair_visibility(tokens("t"), tokens("t")).alias("v"), Window().seen("t", "t").alias("w"), F.size(tokens("t")).alias("n")).collect()
    for y in x:
        assert y.v == y.w and tuple(y.v[f] for f in VISIBILITY_FIELDS) == expected_counts(y.n, y.n)
    # the visible window is E2's head and tail
    qb, rb = pair_budget(F.size(tokens("t")), F.size(tokens("t")), 124, 64)
    line = F.concat(F.lit("input: "), F.array_join(head_tail(tokens("t"), qb), " "), F.lit(" output: "), F.array_join(head_tail(tokens("t"), rb), " "))
    assert df.where(Window().seen("t", "t")["guard_input"] != line).count() == 0


def test_a_users_tokenizer(spark):
    """The five counts with a byte-level vocabulary, for mutated pairs of the driver's conversations."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(VOCABULARY)
    p = C.mutated_pairs(spark, SF).select("query", "response")
    got = guard_pairs(p, "query", "response", ends=tokenizer_ends(tokenizer_file(VOCABULARY))).collect()
    size = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert len(got) > 20
    for r in got:
        assert tuple(r.visibility[f] for f in VISIBILITY_FIELDS) == expected_counts(size(r.query), size(r.response))


def test_a_long_text_is_encoded_in_pieces(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(VOCABULARY)
    r = random.Random(2)
    words = ["alpha", "Über", "naïve", "漢字", "it's", "don't", "x1", "12345", "--", "…", "the", "of", "\n", "\n\n ", "  ", "<|endoftext|>"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    ids = [i for x in pieces(long, 2000) for i in lib.encode(x, add_special_tokens=False).ids]
    assert "".join(pieces(long, 2000)) == long and ids == lib.encode(long, add_special_tokens=False).ids
    assert max(map(len, pieces(long, 2000))) < 4000 and list(pieces("x" * 5000, 100)) == ["x" * 5000]
    most = []

    def setup():
        def encode(text):
            if len(text) > 70_000:
                raise RuntimeError("a piece is too long")
            return list(range(len(text.split())))
        return encode

    big = "ab cd " * 1_800_000  # more than 10 MB
    df = spark.range(1).select(F.lit("q").alias("q"), F.expr("repeat('ab cd ', 1800000)").alias("r"))
    v = guard_pairs(df, "q", "r", ends=tokenizer_ends(setup, 1 << 16)).select("visibility.*").first()
    assert (v.guard_response_total_tokens, v.estimated_visible_tokens) == (len(big.split()), 123) and not most
    w = guard_pairs(df, "q", "r").select("visibility.*").first()
    assert tuple(w[f] for f in VISIBILITY_FIELDS) == tuple(v[f] for f in VISIBILITY_FIELDS)


def test_batches_are_filled_by_tokens():
    r = random.Random(3)
    lengths = [int(r.lognormvariate(4, 1)) + 1 for _ in range(2000)] + [9000]
    batches = budget_batches(lengths, 4096, 64)
    assert sorted(i for b in batches for i in b) == list(range(2001))
    assert all(len(b) <= 64 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 4096) for b in batches)
    plain = [list(range(s, min(s + 16, 2001))) for s in range(0, 2001, 16)]
    real, padded = padding(lengths, batches)
    assert real == sum(lengths) and padded < 1.25 * real and padding(lengths, plain)[1] > 1.8 * real
    assert budget_batches([], 10, 2) == [] and padding([], []) == (0, 0)


def test_classifier_by_budget(spark, tmp_path):
    """One set-up a worker, batches over the borders of Arrow batches, the order and the rows of the plain form."""
    log = str(tmp_path / "log")

    def setup():
        with open(log, "a") as f:
            f.write("setup\n")

        def classify(queries, responses):
            with open(log, "a") as f:
                f.write(f"{len(responses)} {max(len(x.split()) for x in responses)}\n")
            if any("bad" in x for x in responses):
                raise RuntimeError("no")
            return [(len(x) % 97) / 100 for x in responses]
        return classify

    r = random.Random(5)
    rows = [(i, "q", " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([2, 2, 3, 50]))) if i % 40 else "bad") for i in range(400)] + [(400, None, None)]
    df = spark.createDataFrame(rows, "i int, query string, response string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = classify_by_budget(df, setup, budget=200, max_rows=64, retry_rows=True).collect()
        few = classify_by_budget(df, setup, budget=200, max_rows=64, horizon=120).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    def alone(queries, responses):
        if any("bad" in x for x in responses):
            raise RuntimeError("no")
        return [(len(x) % 97) / 100 for x in responses]

    plain = batch_classify(df, alone, retry_rows=True, batch_size=1).collect()
    assert [x.i for x in got] == list(range(401)) == [x.i for x in few]
    assert [(x.i, x.label, x.harmful_probability, x.raw_error) for x in got] == [(x.i, x.label, x.harmful_probability, x.raw_error) for x in plain]
    lines = open(log).read().split("\n")
    assert lines.count("setup") <= 2  # one for each job's only task
    sizes = [tuple(map(int, x.split())) for x in lines if x and x != "setup"]
    assert max(n for n, _ in sizes) > 50 and all(n == 1 or n * m <= 200 for n, m in sizes)
    assert {x.raw_error for x in few if x.label == "unknown"} == {"no"} and sum(x.label == "unknown" for x in few) >= 10


def brute_open(t):
    stack = []
    for i, c in enumerate(t):
        if c in "([{":
            stack.append((c, i))
        elif c in ")]}" and stack and stack[-1][0] == {")": "(", "]": "[", "}": "{"}[c]:
            stack.pop()
    return stack


def test_bracket_stack(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("()[]{}ab") for _ in range(r.randrange(60))) for _ in range(300)]
    texts += ["".join(r.choice("([{([{)]}") for _ in range(500)) for _ in range(20)] + ["(" * 40 + ")" * 25 + "[" * 30 + "]" * 9 + "x}", "", ")))"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: (bytes(x.o).decode(), x.k) for x in df.select("i", open_delimiters(F.col("t")).alias("o"), unclosed_index(F.col("t")).alias("k")).collect()}
    assert got == {i: ("".join(c for c, _ in reversed(o)), o[-1][1] if o else None) for i, o in enumerate(map(brute_open, texts))}


def test_deeply_nested_brackets_are_quick(spark):
    import time
    began = time.time()
    df = spark.range(2).select(F.expr("if(id = 0, repeat('(', 100000), concat(repeat('([{', 30000), repeat(')', 1000), repeat('}])', 9))) as t"))
    got = df.select(F.octet_length(open_delimiters(F.col("t"))).alias("n"), unclosed_index(F.col("t")).alias("k")).collect()
    assert sorted(map(tuple, got)) == [(90_000 - 27, 90_000 - 28), (100_000, 99_999)] and time.time() - began < 60
