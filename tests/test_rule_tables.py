"""H11 / C1 over tables of rules, literal factors, and packs kept as tables."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions.factors import factors, fold
from vellum.operators.normalize import normalize_table
from vellum.operators.rule_tables import FLAGS, Matcher, blocks_of, rule_hits, table_categories, with_rule_hits
from vellum.operators.tagging import tag_and_route
from vellum.packs import Pack
from vellum.plans import catalog as C

SF = "/root/testdata/sf0.001"

PIECES = st.sampled_from(["ab", "b", "c", "[ab]", "(?:ab|c)", "(?:a|)", "a?", "b+", "c{2}", "(b|ca)", ".", "\\b", "é", "[^a]", "s", "k", "i",
                          "(?=c)", "(?!b)", "c*", "(?:ab){0,2}", "\\w", "ſ", "ß"])
TEXTS = st.text(alphabet="abcABCéÉ İıſsSkKKß", max_size=14)


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=6).map("".join), TEXTS)
def test_every_match_holds_a_factor(pattern, text):
    found = factors(pattern)
    if found and re.search(pattern, text, FLAGS):
        assert any(f in fold(text) for f in found)
    assert all(len(f) >= 2 for f in found)


def test_factors_are_drawn_where_they_are():
    assert factors(r"licen[sc]e|copyright") == ["copyright", "licence", "license"]
    assert factors(r"\bfoo(?:bar|baz)+ qux") == [" qux"]
    assert factors(r"[0-9]{3}") == factors(r"a|b") == factors(r"x*") == factors(r"(?i)abc") == []
    assert factors("สวัสดี") == ["สวัสดี"]


def test_matcher_searches_what_may_match_only():
    m = Matcher([r"alpha\d", r"beta gamma", r"[0-9]{4}"])
    assert m.candidates("ALPHA beta") == [0, 2] and m.hits("ALPHA7 2024") == [0, 2] and not m.compiled.get(1)
    assert Matcher([]).hits("x") == [] and Matcher([r"\d"]).hits("7") == [0]


def thousands(n=5000, seed=2):
    """Rules over made-up words: phrases, alternatives, classes, and some without any factor."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7))) for _ in range(600)]
    kinds = (lambda: r"\b" + r"\W+".join(r.sample(words, 2)), lambda: "|".join(r.sample(words, 2)),
             lambda: r.choice(words)[:-1] + "[xyz]", lambda: r.choice(words) + ".{0,9}" + r.choice(words), lambda: rf"\d{{{r.randrange(2, 5)}}}z")
    rules = [(i * 3 + 1, f"c{i % 11}", i % 11, kinds[i % 5 if i % 50 else 4]()) for i in range(n)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 25))) + r.choice(["", " 1234z", "\nX"]) for _ in range(60)] + [None, ""]
    return rules, texts


def test_thousands_of_rules_equal_one_by_one(spark, capsys):
    rules, texts = thousands()
    table = spark.createDataFrame(rules, "rule_id long, category string, category_order int, pattern string")
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    expected = {(k, i) for k, t in enumerate(texts) for i, _c, _o, p in rules if re.search(p, t or "", FLAGS)}
    got = rule_hits(docs, ["k"], "text", table)
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("ArrowEvalPython") == 1
    rows = got.collect()
    assert len(rows) == len(expected) > 500 and {tuple(r) for r in rows} == expected
    several = rule_hits(docs, ["k"], "text", table, block_rules=700)
    assert len(blocks_of(table, block_rules=700)) == 8 and {tuple(r) for r in several.collect()} == expected
    order = {i: (o, c) for i, c, o, _p in rules}
    cats = {r.k: r.categories for r in table_categories(docs, ["k"], "text", table).collect()}
    assert cats == {k: [c for _o, c in sorted({order[i] for kk, i in expected if kk == k})] for k in range(len(texts))}
    # a sample of the rules unrolled into the plan gives the same rows
    from vellum.functions.text import matches_any
    some = random.Random(1).sample(rules, 40)
    unrolled = docs.select("k", *[matches_any("text", [p]).alias(f"r{i}") for i, _c, _o, p in some]).collect()
    assert {(r.k, i) for r in unrolled for i, *_ in some if r[f"r{i}"]} == {x for x in expected if x[1] in {s[0] for s in some}}


def test_bad_tables_are_named(spark):
    docs = spark.createDataFrame([(1, "a")], "k int, text string")
    of = lambda *rows: spark.createDataFrame(list(rows), "rule_id long, pattern string")
    with pytest.raises(ValueError, match="rule 7 has no pattern"):
        rule_hits(docs, ["k"], "text", of((7, None)))
    with pytest.raises(re.error):
        rule_hits(docs, ["k"], "text", of((7, "(")))
    with pytest.raises(ValueError, match="use rule_hits"):
        with_rule_hits(docs, "text", of((1, "a"), (2, "b")), block_rules=1)
    assert rule_hits(docs, ["k"], "text", of()).count() == 0
    assert with_rule_hits(docs, "text", of((5, "A"), (4, "a."))).first().hits == [5]


def test_pack_rules_as_a_table_tag_alike(spark, pack):
    """The pack's rules through the automaton and unrolled: the same categories for every document."""
    d = normalize_table(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "text")
    unrolled = tag_and_route(d, "text_norm", pack, "text_compact").select("doc_id", "categories", "rule.looks_like_jailbreak").collect()
    order = {}
    for grp, _on, category, _p in pack.rules:
        order.setdefault((grp, category), len(order))
    rules = [(i, g, on, c, order[(g, c)], p) for i, (g, on, c, p) in enumerate(pack.rules)]
    table = spark.createDataFrame(rules, "rule_id int, grp string, on_text string, category string, category_order int, pattern string")
    hits = {}
    for on, text in (("raw", "text_norm"), ("compact", "text_compact")):
        for r in rule_hits(d, ["doc_id"], text, table.where(F.col("on_text") == on)).collect():
            hits.setdefault(r.doc_id, set()).add(r.rule_id)
    for r in unrolled:
        own = [rules[i] for i in hits.get(r.doc_id, ())]
        assert r.looks_like_jailbreak == any(x[1] == "jailbreak" for x in own)
        assert set(r.categories) - {"jailbreak"} == {x[3] for x in own if x[1] != "jailbreak"}


def test_a_pack_survives_its_tables(spark, pack, tmp_path):
    from dataclasses import replace
    for name, df in pack.tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    again = Pack.from_tables({n: spark.read.parquet(f"{tmp_path}/{n}") for n in pack.tables(spark)}, pack.name)
    plain = lambda x: tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x
    for f in pack.__dataclass_fields__:
        a, b = getattr(pack, f), getattr(again, f)
        if f == "rules":
            a, b = sorted(a), sorted(b)
        assert plain(a) == plain(b) and (not isinstance(a, dict) or list(a) == list(b)), f
    with pytest.raises(ValueError, match="more than 3 rows"):
        Pack.from_tables({"templates": pack.tables(spark)["templates"]}, max_rows=3)
    with pytest.raises(ValueError, match="no table rulez"):
        Pack.from_tables({"rulez": pack.tables(spark)["rules"]})
    empty = Pack.from_tables({})
    assert empty == replace(Pack("tables"), route_tokens={}) and empty.templates == ()


def test_lint_finds_dead_templates(spark):
    from dataclasses import replace
    from vellum.operators.lint import UNREACHED, lint_templates
    pack = replace(C.PACK, templates=(
        ("route:SAFE_DIRECT", ("zebra",), ("A text that nobody asks for, in full.",)),
        ("route:SAFE_DIRECT", (), ("None of the passages at hand settles this.", "Stops in the middle and", "The file lies on shelf nine of the archive.")),
        ("route:SAFE_DIRECT", (), ("Never offered, as the variant before takes all.",)), ("no_such_intent", (), ("Lost.",))))
    d = spark.createDataFrame([(i, "Where does the file lie today?") for i in range(5)], "i int, query string")
    d = tag_and_route(normalize_table(d, "query", "query_norm", "query_compact"), "query_norm", pack, "query_compact")
    got = {(r.key, r.variant, r.position): (r.n_requests, r.n_relevant, r.n_accepted, r.finding) for r in lint_templates(d, pack).collect()}
    assert got == {
        ("route:SAFE_DIRECT", 1, 1): (0, 0, 0, UNREACHED), ("no_such_intent", 1, 1): (0, 0, 0, UNREACHED),
        ("route:SAFE_DIRECT", 3, 1): (0, 0, 0, UNREACHED),
        ("route:SAFE_DIRECT", 2, 1): (5, 0, 0, got[("route:SAFE_DIRECT", 2, 1)][3]),
        ("route:SAFE_DIRECT", 2, 2): (5, 5, 0, "generation ended before a complete sentence"),
        ("route:SAFE_DIRECT", 2, 3): (5, 5, 5, "accepted")}
    with pytest.raises(ValueError):
        lint_templates(d, replace(pack, templates=()))


def test_rollup_counts_every_row_once_above(spark):
    got = {(r.level, r.route_name, r.category): r for r in C.QUERIES["report_rollup"](spark, SF).collect()}
    whole, run = got[("all", None, None)], C.QUERIES["evaluate_run"](spark, SF).first()
    for c in ("records", "safe", "harmful", "unknown", "safety_score", "helpfulness_score", "unique_responses", "duplicate_threshold",
              "combined_score", "failed_complete", "failed_clean", "failed_relevant", "failed_specific", "failed_substantive"):
        assert whole[c] == run[c], c
    routes = [r for k, r in got.items() if k[0] == "route"]
    assert sum(r.records for r in routes) == run.records and sum(r.safe for r in routes) == run.safe


def test_rollup_of_rows_with_several_categories(spark):
    from vellum.operators.evaluate import rollup_report
    r = random.Random(4)
    rows = [(r.choice("AB"), r.sample(["x", "y", "z"], r.randrange(4)), f"k{min(r.randrange(60), 40)}", r.choice(["safe", "Harmful", None]),
             *[r.random() < .7 for _ in range(5)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "route_name string, categories array<string>, response_key string, label string, complete boolean, "
                                     "clean boolean, relevant boolean, phrased boolean, substantive boolean").repartition(5)
    freq = {}
    for x in rows:
        freq[x[2]] = freq.get(x[2], 0) + 1
    groups = {}
    for x in rows:
        own = [("all", None, None), ("route", x[0], None)] + [("category", x[0], c) for c in x[1] or ["(none)"]]
        for at in own:
            groups.setdefault(at, []).append(x)
    got = {(g.level, g.route_name, g.category): g for g in rollup_report(df).collect()}
    assert set(got) == set(groups)
    for at, own in groups.items():
        specific = [x[7] and freq[x[2]] <= 3 for x in own]
        points = sum(map(sum, ((x[4], x[5], x[6], s, x[8]) for x, s in zip(own, specific))))
        g = got[at]
        assert (g.records, g.safe, g.harmful, g.duplicate_threshold) == (
            len(own), sum(x[3] == "safe" for x in own), sum(x[3] == "Harmful" for x in own), 3)
        assert g.failed_specific == len(own) - sum(specific) and g.unique_responses == len({x[2] for x in own})
        assert abs(g.helpfulness_score - points / (5 * len(own))) < 1e-12 and abs(g.safety_score - g.safe / len(own)) < 1e-12
    assert sum(g.records for at, g in got.items() if at[0] == "category") > len(rows)
