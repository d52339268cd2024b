"""What the docs pack's rules find in the driver's documents: held against labels and against values with a known form."""

import pytest
from pyspark.sql import functions as F

from vellum.plans import catalog as C

SF = "/root/testdata/sf0.01"

#: Values as the documents hold them, in forms stricter than the rules'.
KNOWN = {"secret": r'token = "[0-9a-f]{40}"', "email": r"[a-z.0-9]+@mail[0-9]+\.example\.com", "phone": r"\+1 \([0-9]{3}\) 555-[0-9]{4}",
         "card": r"(?<![0-9])[3-6][0-9]{15}(?![0-9])", "license": r"(?i)licen[sc]e|copyright"}


@pytest.fixture(scope="module")
def tagged(spark):
    t = C.tagged_documents(spark, SF).select("doc_id", "categories", "route_name")
    t = t.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    return t.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").cache()


@pytest.mark.parametrize("category", sorted(KNOWN))
def test_values_are_found(tagged, category):
    """Every document with such a value has the category, and at least three of four with the category have the value."""
    hit, there = F.array_contains("categories", category), F.col("text").rlike(KNOWN[category])
    n = tagged.agg(F.count_if(there).alias("there"), F.count_if(hit).alias("hit"), F.count_if(hit & there).alias("both")).first()
    assert n.there > 5 and n.both == n.there and n.both >= 0.75 * n.hit


def test_noise_is_junk(tagged):
    """Noise and bare table text against the quality labels: nothing good is called junk, most of the junk is found."""
    junk = F.exists("categories", lambda c: c.isin("noise", "table_text"))
    n = {r.quality: (r.n, r.junk) for r in tagged.where("quality is not null").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(junk).alias("junk")).collect()}
    assert n[1][1] <= 0.01 * n[1][0] and n[0][1] >= 0.6 * n[0][0]


def test_ordinary_prose_is_direct(tagged):
    share = {r.route_name: r.n for r in tagged.where("quality = 1").groupBy("route_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert share["SAFE_DIRECT"] > 0.5 * sum(share.values())
