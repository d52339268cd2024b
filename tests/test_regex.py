"""The rule compiler gives Python's ``re`` answers on Java (Spark) and RE2 (DuckDB)."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions.regex import sql_str, to_java, to_re2

PATTERNS = [
    r"\bgun\b", r"\b(?:und|nicht)\b.{0,60}\bder\b", r"\b(?:with|from)\b.{0,40}\b(?:that|this)\b",
    r"caf\w+", r"a\s+b", r"\d{2,}", r"ready:\s*$", r"(?:api[_ -]?key|token) *=", r"\bdel\b",
]
TEXTS = [
    "a gun", "shotgun", "นี้gunนะ", "und so der Mann", "with that", "with  a thing this", "café crème",
    "a b", "a b", "١٢٣", "12", "ready:\n", "ready: x", "TOKEN = 1", "el del año", "déla", "ungung",
    "Kelvin K", "withé that",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_java_matches_python(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(to_java(pattern, "is"))).collect()]
    want = [bool(re.search(pattern, t, re.I | re.S)) for t in TEXTS]
    assert got == want


@pytest.mark.parametrize("pattern", PATTERNS)
def test_re2_matches_python(pattern):
    con = duckdb.connect()
    re2 = to_re2(pattern, "is")
    got = [con.execute(f"SELECT regexp_matches(?, {sql_str(re2)})", [t]).fetchone()[0] for t in TEXTS]
    want = [bool(re.search(pattern, t, re.I | re.S)) for t in TEXTS]
    assert got == want


def test_lookaround_rejected_for_re2():
    with pytest.raises(ValueError):
        to_re2(r"(?<!x)y")
