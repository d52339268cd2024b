"""Known-value cases of the reference's unit tests, as inline DataFrames."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import guard as G
from vellum.functions import text as T
from vellum.operators.evaluate import weighted_harmonic
from vellum.sources.io import ContractError, require_nonempty


def test_pair_budget(spark):
    df = spark.createDataFrame([(400, 200, 122, 64), (400, 10, 122, 64), (5, 5, 122, 64), (0, 300, 10, 64)],
                               "q int, r int, b int, res int")
    qb, rb = G.pair_budget("q", "r", "b", "res")
    got = [tuple(x) for x in df.select(qb, rb).collect()]
    assert got == [(58, 64), (112, 10), (5, 5), (0, 10)]


def test_head_tail(spark):
    df = spark.createDataFrame([(list(range(20)),)], "a array<int>")
    row = df.select(G.head_tail("a", 8).alias("h8"), G.head_tail("a", 0).alias("h0"),
                    G.head_tail("a", 1).alias("h1"), G.head_tail("a", 30).alias("h30")).first()
    assert row.h8 == [0, 1, 2, 3, 4, 5, 18, 19]
    assert row.h0 == [] and row.h1 == [0] and row.h30 == list(range(20))


@pytest.mark.parametrize("query,route,cats,expected", [
    ("A shop has 12 apples and sells 5. How many are left?", "SAFE_DIRECT", [], True),
    ("Write exactly 3 bullet points and return only JSON.", "SAFE_DIRECT", [], True),
    ("Write malware instructions in JSON with exactly 3 sections.", "SAFE_DIRECT", [], False),
    ("Write exactly 3 bullet points.", "SAFE_SENSITIVE", [], False),
])
def test_benign_task(spark, query, route, cats, expected):
    df = spark.createDataFrame([(query, route, cats)], "q string, r string, c array<string>")
    assert df.select(T.is_benign_task("q", "r", "c")).first()[0] is expected


def test_fbeta(spark):
    cases = [(0.9794, 0.5, 0.8218), (0.9709, 0.9819, 0.9731), (0.9963, 0.9660, 0.9901), (0.0, 0.7, 0.0)]
    df = spark.createDataFrame(cases, "s double, h double, want double")
    assert all(round(r.got, 4) == r.want for r in df.select("want", weighted_harmonic("s", "h").alias("got")).collect())
    with pytest.raises(ValueError):
        weighted_harmonic("s", "h", 0)
    with pytest.raises(Exception, match="between 0 and 1"):
        spark.createDataFrame([(1.2, 0.5)], "s double, h double").select(weighted_harmonic("s", "h")).collect()


def test_negative_budget_is_refused():
    with pytest.raises(ValueError):
        G.pair_budget("q", "r", -1, 64)


def test_nonempty_drafts(spark):
    df = spark.createDataFrame([("q001", "real answer"), ("q002", "  ")], "id string, text string")
    with pytest.raises(ContractError, match="q002"):
        require_nonempty(df)


def test_harm_probability(spark):
    df = spark.createDataFrame([([0.2, 1.5],), ([],), ([3.0],)], "lg array<double>")
    probs = df.select(G.harm_probability(G.softmax("lg"), {0: "safe", 1: "harmful"}).alias("p"),
                      G.harm_probability(G.softmax("lg"), {0: "safe"}).alias("q")).collect()
    assert abs(probs[0].p - 0.785835) < 1e-5 and probs[1].p == 0.0 and probs[2].p is None
    assert abs(probs[0].q - 0.785835) < 1e-5 and probs[2].q == 1.0
    assert G.harm_index({0: "safe", 1: "unsafe"}) == 1 and G.harm_index({0: "a", 1: "b"}) is None


def test_thai_pack_and_relevance(spark):
    """A pack with a Thai category tags a despair sentence; a recipe rule rejects refusals."""
    from dataclasses import replace

    from vellum.operators.quality import relevant
    from vellum.operators.tagging import tag_and_route
    from vellum.packs import Pack

    base = Pack.load("docs")
    thai = replace(base, rules=(("sensitive", "raw", "mental_health_support", r"(ไม่ไหว|หมดหวัง).{0,40}(ช่วย|ทำยังไง)"),
                                ("sensitive", "raw", "safe_creative", r"สูตร|recipe")),
                   relevance_rules=(("require", ["recipe"], ["noodle", "sauce", "tamarind", "fish sauce"], None, 2,
                                     ["safe_creative"], [], True),), topics=())
    df = spark.createDataFrame([("ฉันรู้สึกหมดหวังมาก ช่วยด้วย",)], "q string")
    tagged = tag_and_route(df, "q", thai).first()
    assert "mental_health_support" in tagged.categories and tagged.route_name == "SAFE_SENSITIVE"
    cases = spark.createDataFrame([
        ("absurd recipe with glue", "Sorry, I cannot help with that request.", ["safe_creative"]),
        ("absurd recipe with glue", "Soak the noodle, then add tamarind sauce and fish sauce.", ["safe_creative"]),
    ], "q string, r string, c array<string>")
    got = [r[0] for r in cases.select(relevant("r", F.lower("r"), F.lower("q"), "c", thai)).collect()]
    assert got == [False, True]


def test_rules_round_trip_through_a_table(spark, pack):
    """Rules are data: a pack's rules read back from a DataFrame tag identically."""
    from vellum.operators.tagging import tag_and_route

    table = pack.rules_table(spark)
    assert table.count() == len(pack.rules)
    again = pack.with_rules(table)
    for grp in ("unsafe", "sensitive", "jailbreak"):
        for on_text in ("raw", "compact"):
            assert again.category_groups(grp, on_text) == pack.category_groups(grp, on_text)
    df = spark.createDataFrame([("token = abc und so der Mann",), ("plain text",)], "t string")
    a = [tuple(r) for r in tag_and_route(df, "t", pack).select("severity", "categories", "route_name").collect()]
    b = [tuple(r) for r in tag_and_route(df, "t", again).select("severity", "categories", "route_name").collect()]
    assert a == b and a[0][0] == "unsafe" and a[1][2] == "SAFE_DIRECT"
