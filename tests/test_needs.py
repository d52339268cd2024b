"""Strings that matches need, and the column forms that ask for them first, against plain searches and Python."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.factors import fold_digits, needs
from vellum.functions.regex import to_java
from vellum.operators.normalize import normalize_steps, squeeze
from vellum.plans import catalog as C

PIECES = st.sampled_from(["ab", "b", "[ab]", "(?:ab|c)", "(?:a|)", "a?", "b+", "c{2}", "(b|ca)", ".", "\\b", "é", "[^a]", "s", "k", "i", "(?=c)",
                          "(?!b)", "c*", "(?:ab){0,2}", "\\w", "ſ", "ß", "[0-9]", "[0-9]{1,3}", "5", "[3-6]{2}", "\\d", "(?:[0-9]{1,2}b){2}",
                          "(?:ab|a){1,2}", "(?:b.a|c)", "[a1]", "(?:7|x)", "|"])
TEXTS = st.text(alphabet="abcABCéÉ İıſsSkKKß01357x", max_size=14)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=7).map("".join), TEXTS)
def test_every_match_holds_one_of_each_set(pattern, text):
    if re.search(pattern, text, re.I | re.S):
        assert all(any(f in fold_digits(text) for f in any_of) for any_of in needs(pattern))


def test_every_rule_of_the_pack_asks_for_strings_first():
    assert [r for r in C.PACK.rules if not needs(r[3])] == []
    assert needs(r"\b(?:with|from)\b.{0,40}\b(?:that|this)\b") == [["from", "with"], ["that", "this"]]
    assert needs(r"[0-9]{13,19}") == [["0" * 13]] and needs(r"a*|b") == needs(r"(?i)abc") == needs(r"\w+") == []


def odd_texts(seed=5, n=400):
    r = random.Random(seed)
    bits = ["with", "FROM", " this ", "that", "und ", " der ", "nicht", "token", " =", "K", "ſecret", "paſsword=", "İ", "ı", "LİCENSE", "licence", "@", "a.bc",
            "1.2.3.4", "4111111111111111", "+1 (555) 555-0100", "***", "$$$", " | x | ", "\n", "\n\n\n", "  ", "\t", "​", "\x01", " ", "　",
            " ", "2.", "-", "•", "Note:", "：", " and", "such as", "รวมถึง", "(", "]", "www.x", "https://a.b", "httpſ://q", ")", "avec", "para"]
    return ["", " ", None, "\n-", "x and ", "and", "x\n12)  ", "including", "zincluding"] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def test_asking_first_changes_nothing(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "i int, t string").withColumn("f", T.fold_digits("t")).cache()
    for _g, _on, category, p in C.PACK.rules:
        both = d.select("t", T.searched("t", "f", [p]).alias("a"), T.matches_any("t", [p]).alias("b"))
        assert both.where("a <> b").collect() == [], category


def test_ends_and_steps_equal_plain_searches(spark):
    d = spark.createDataFrame([(t,) for t in odd_texts(9)], "t string")
    s = T.unicode_rstrip("t")
    plain = (s == "") | T.has_unclosed_structure(s)
    for p, flags in ((T.DANGLING_LIST_PATTERN, ""), (T.DANGLING_HEADING_PATTERN, ""), (T.CONNECTOR_PATTERN, "i")):
        plain = plain | s.rlike(to_java(p, flags))
    url = lambda c: F.regexp_extract(c, to_java(T.TRAILING_URL_PATTERN, "i"), 0)
    t = F.coalesce("t", F.lit(""))
    rows = d.select("t", T.unicode_strip("t").alias("strip"), s.alias("rstrip"), T.incomplete_ending("t", quick=True).alias("end"), plain.alias("plain"),
                    url(s).alias("url"), url(F.substring_index(s, " ", -1)).alias("last_url"),
                    normalize_steps(t, None, quick=True).alias("steps"), T.unicode_strip(squeeze(t)).alias("every_step")).collect()
    for r in rows:
        assert (r.strip, r.rstrip) == ((r.t or "").strip(), (r.t or "").rstrip()), repr(r.t)
        assert r.end == r.plain and r.url == r.last_url and r.steps == r.every_step, repr(r.t)


def test_topics_are_substrings_in_lower_case(spark):
    table = [("a", ["ſ", "token ="]), ("digits", list("0123456789")), ("ends", ["]", "-", "^"]), ("none", []), ("word", [" AND"])]
    d = spark.createDataFrame([(t,) for t in odd_texts(3)], "t string")
    for r in d.select("t", T.topics("t", table, quick=True).alias("x"), F.lower("t").alias("low")).collect():
        assert r.x == [n for n, keys in table if any(k.lower() in (r.low or "") for k in keys)], repr(r.t)
