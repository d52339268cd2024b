"""J7 and J8 on the smallest driver tables: invariants, contracts, scorer calls."""

import pytest
from pyspark.sql import functions as F

from vellum.operators.cascade import STAGES, cascade_counters, expression_scorer, guarded_select, udf_scorer
from vellum.operators.evaluate import evaluate_run, response_key
from vellum.operators.guard import batch_classify, join_assessments
from vellum.operators.normalize import normalize_table, normalize_text
from vellum.operators.tagging import tag_and_route
from vellum.plans import catalog as C
from vellum.plans.respond import respond
from vellum.sources.tables import pairs_of

SF = "/root/testdata/sf0.001"
KNOWN = set(STAGES.values()) | {"draft_accepted", "rewrite_accepted", "final_quality_backstop"}
CALM = expression_scorer(lambda q, t, i: F.lit(0.1))


def requests(spark, *queries):
    return spark.createDataFrame([(i, f"q{i}", q) for i, q in enumerate(queries)], "original_index long, id string, query string")


def drafts(spark, *texts):
    return spark.createDataFrame([(i, t, None) for i, t in texts], "original_index long, text string, finish_reason string")


def test_job_without_rewrites(spark):
    r = requests(spark, "Name the archive of the file.", "Which page is it on?")
    d = drafts(spark, (0, "The file lies in the town archive, shelf nine, under its old number."), (1, "It is on page four and"))
    rows = {x.id: x for x in respond(r, d, C.PACK, CALM).collect()}
    assert rows["q0"].stage == "draft_accepted" and rows["q0"].draft_finish_reason == "unknown"
    assert rows["q1"].stage in KNOWN - {"draft_accepted"} and rows["q1"].rewrite_text is None and rows["q1"].response


@pytest.mark.parametrize("answers,why", [
    ([(0, "A sound answer, in full.")], "no model draft for id q1"),
    ([(0, "A sound answer, in full."), (1, "<think>nothing</think>  ")], "blank model draft for id q1"),
    ([(0, "A sound answer, in full."), (1, "x"), (1, "y")], "more than one draft for request 1")])
def test_drafts_must_be_there_once(spark, answers, why):
    with pytest.raises(Exception, match=why):
        respond(requests(spark, "a", "b"), drafts(spark, *answers), C.PACK, CALM).collect()


def test_cascade_scores_only_open_rows(spark):
    """A user classifier gets as many texts as the counters say, tier 5 reusing tier 3; a failing chunk is unknown."""
    asked = spark.sparkContext.accumulator(0)

    def classify(queries, texts):
        asked.add(len(texts))
        if any("credential" in t.lower() for t in texts):
            raise RuntimeError("model refused the batch")
        return [min(len(t) / 300.0, 1.0) for t in texts]

    s = C.selected_pairs(spark, SF, scorer=udf_scorer(classify, batch_size=1)).cache()
    rows = s.collect()
    assert len(rows) == C.mutated_pairs(spark, SF).count()
    assert all(r.selected.label in ("safe", "harmful", "unknown") and r.selected.text for r in rows)
    n = cascade_counters(s).first()
    assert asked.value == sum(n[f"tier{k}_scored"] for k in (1, 2, 3, 4, 6))
    assert sum(n[f"tier{k}_accepted"] for k in range(1, 7)) == len(rows)


def test_cascade_takes_any_number_of_model_answers(spark):
    df = spark.createDataFrame([(0, "Write exactly 3 bullet points in JSON: a shelf list", "No.", "No.", "Shelf 1, shelf 2 and shelf 3 hold the list.")],
                               "original_index long, query string, m1 string, m2 string, m3 string")
    df = tag_and_route(normalize_table(df, "query", "query_norm", "query_compact"), "query_norm", C.PACK, "query_compact")
    by_length = expression_scorer(lambda q, t, i: F.when(F.length(t) > 30, 0.1).otherwise(0.9))
    s = guarded_select(df, C.PACK, by_length, ["m1", "m2", "m3"]).first()
    assert (s.selected.tier, s.selected.position) == (1, 3) and s.tier_counts[0] == 2  # m2 repeats m1


def test_hot_conversation_is_cut_into_blocks(spark):
    turns = spark.range(100_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                        F.col("id").cast("string").alias("text"))
    p = pairs_of(turns, block=1000)
    assert p.count() == 50_000 and p.where("cast(response as long) != turn + 1").count() == 0
    assert p.where("turn < 99998 and cast(rewrite as long) != turn + 3").count() == 0
    assert p.select("original_index").distinct().count() == 50_000
    sparse = spark.createDataFrame([(1, 5, "user", "a"), (1, 40, "assistant", "b"), (1, 90, "user", "c"), (1, 2000, "assistant", "d")],
                                   "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, r.response, r.rewrite) for r in pairs_of(sparse, block=10).collect()) == [(5, "b", "d"), (90, "d", None)]


def test_texts_that_differ_late_are_different_answers(spark):
    base = "word " * 3000
    df = spark.createDataFrame([("q", base + x, "safe") for x in ("one", "two", "one")], "query string, response string, label string")
    r = evaluate_run(df, C.PACK).first()
    assert (r.records, r.unique_responses) == (3, 2)
    assert df.select(response_key(normalize_text("response"))).distinct().count() == 2


def test_evaluation_plan_shuffles_no_text(spark, capsys):
    C.QUERIES["evaluate_documents"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") // 2 == 2 and "response_norm" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line)


def test_failing_chunk_is_isolated(spark):
    def classify(queries, texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [0.2] * len(texts)
    df = spark.createDataFrame([("q", t) for t in ("a", "bad", "b", "c")], "query string, response string").coalesce(1)
    got = [(r.label, r.harmful_probability, r.raw_error) for r in batch_classify(df, classify, batch_size=2).collect()]
    assert got == [("unknown", 1.0, "no")] * 2 + [("safe", 0.2, None)] * 2


def test_a_second_assessment_fails(spark):
    a = spark.createDataFrame([(1, "safe", 0.1), (1, "safe", 0.2)], "k long, label string, harmful_probability double")
    with pytest.raises(Exception, match="more than one assessment for 1"):
        join_assessments(spark.createDataFrame([(1,)], "k long"), a, "k").collect()
