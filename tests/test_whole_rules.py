"""Known values at sf0.01: what the queries' SQL gave in DuckDB before rules were taken out of it (commit c8c2ef5)."""

from collections import Counter

from vellum.plans import catalog as C

SF = "/root/testdata/sf0.01"


def rows(spark, name, *columns):
    df = C.QUERIES[name](spark, SF)
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def one(spark, name):
    return C.QUERIES[name](spark, SF).first().asDict()


def test_category_counts(spark):
    got = dict(rows(spark, "category_counts", "category", "n"))
    want = {"french": 118, "german": 113, "spanish": 87, "long_digits": 24, "run_on": 132, "ipv4": 25}
    assert {c: got.get(c) for c in want} == want


def test_unsafe_documents(spark):
    reasons = [r for r, in rows(spark, "unsafe_documents", "route_reason")]
    named = {c: sum(c in r for r in reasons) for c in ("run_on", "long_digits", "french", "spanish")}
    assert len(reasons) == 12 and named == {"run_on": 4, "long_digits": 4, "french": 4, "spanish": 2}


def test_quality_flags(spark):
    flags = rows(spark, "quality_flags", "requires_direct", "helpfulness_priority", "relevant")
    assert [sum(f) for f in zip(*flags)] == [9, 32, 180]


def test_quality_counts(spark):
    got = one(spark, "quality_counts")
    assert (got["n_requires_direct"], got["n_helpfulness_priority"]) == (9, 32)


def test_benign_tasks(spark):
    got = Counter(rows(spark, "benign_tasks", "route_name", "benign"))
    assert got == {("SAFE_DIRECT", True): 97, ("SAFE_DIRECT", False): 101, ("SAFE_SENSITIVE", False): 32, ("UNSAFE", False): 3}


def test_guarded_select(spark):
    got = Counter(s for s, in rows(spark, "guarded_select", "stage"))
    assert got == {"benign_model_recovered": 13, "model_boundary_accepted": 10, "fallback_accepted": 88,
                   "fallback_boundary_accepted": 20, "fallback_safe_backstop": 102}


def test_cascade_counters(spark):
    got = one(spark, "cascade_counters")
    assert [got[f"tier{k}_scored"] for k in range(1, 7)] == [32, 21, 236, 60, 1, 102]
    assert [got[f"tier{k}_accepted"] for k in range(1, 7)] == [13, 10, 88, 20, 0, 102] and got["backstop_guard_passed"] == 1


def test_report_by_route(spark):
    assert {r[0]: r[1] for r in rows(spark, "report_by_route")} == {"SAFE_DIRECT": 198, "SAFE_SENSITIVE": 32, "UNSAFE": 3}


def test_guarded_select_preserving(spark):
    got = Counter(s for s, in rows(spark, "guarded_select_preserving", "stage"))
    assert got == {"benign_model_recovered": 13, "model_boundary_accepted": 10, "fallback_accepted": 88,
                   "fallback_boundary_accepted": 20, "fallback_context_preserved": 1, "fallback_safe_backstop": 101}


def test_respond_decisions(spark):
    got = Counter(c for c, in rows(spark, "respond_decisions", "categories"))
    assert got == {"": 198, "claim": 5, "french": 9, "german": 10, "run_on": 2, "run_on|claim": 1, "spanish": 8}


def test_respond_diagnostics(spark):
    got = one(spark, "respond_diagnostics")
    want = {"records": 233, "rewrite_requests": 163, "final_fallbacks": 124, "rewrite_truncation_unresolved": 74,
            "relevance_rejections": 6, "tier2_scored": 5, "tier2_accepted": 4, "tier5_scored": 1, "tier6_scored": 50}
    assert {c: got[c] for c in want} == want


def test_respond_counts(spark):
    got = {(c, v): n for c, v, n in rows(spark, "respond_counts", "counter", "value", "n") if c in ("category", "route")}
    assert got == {("category", "claim"): 6, ("category", "french"): 9, ("category", "german"): 10, ("category", "run_on"): 3,
                   ("category", "spanish"): 8, ("route", "SAFE_DIRECT"): 198, ("route", "SAFE_SENSITIVE"): 32, ("route", "UNSAFE"): 3}


def test_respond_stage_counts(spark):
    assert dict(rows(spark, "respond_stage_counts", "stage", "n")) == {
        "draft_accepted": 70, "rewrite_accepted": 39, "benign_model_recovered": 4, "model_boundary_accepted": 4,
        "fallback_accepted": 53, "fallback_boundary_accepted": 13, "fallback_safe_backstop": 50}
