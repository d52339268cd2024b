"""The pack of the registered queries asks every rule, also those that ``docs`` leaves out."""

import re

import pytest

from vellum.functions.text import compact_text
from vellum.operators.normalize import normalize_text
from vellum.packs import Pack
from vellum.plans import catalog as C

SF = "/root/testdata/sf0.01"

#: Rules and the texts they are asked of, as Python searches them.
ASKED = {"long_digits": ("t", r"[0-9]{13,19}"), "run_on": ("c", r"thereon|withthe"), "french": ("t", r"\b(?:avec|pour)\b"),
         "german": ("t", r"\b(?:und|nicht)\b.{0,60}\bder\b"), "spanish": ("t", r"\b(?:para|como|del)\b"),
         "ipv4": ("t", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")}


@pytest.fixture(scope="module")
def texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(normalize_text("text").alias("t"))
    return d.withColumn("c", compact_text("t")).collect()


def test_category_counts_have_every_rule(spark, texts):
    got = {r.category: r.n for r in C.QUERIES["category_counts"](spark, SF).collect()}
    want = {c: sum(bool(re.search(p, r[on], re.I | re.S)) for r in texts) for c, (on, p) in ASKED.items()}
    assert min(want.values()) > 5 and {c: got.get(c, 0) for c in want} == want


def test_pairs_have_every_route(spark):
    assert {r.route_name for r in C.QUERIES["report_by_route"](spark, SF).collect()} == {"SAFE_DIRECT", "SAFE_SENSITIVE", "UNSAFE"}


def test_nothing_of_the_docs_pack_is_missing():
    wide, docs = Pack.load("documents"), Pack.load("docs")
    assert C.PACK == wide
    assert [r for r in docs.rules if r not in wide.rules and r[2] != "ipv4"] == []
    assert all(t in wide.templates for t in docs.templates) and all(i in wide.intents for i in docs.intents)
    assert [t[0] for t in wide.templates if t not in docs.templates] == ["language_help"]
