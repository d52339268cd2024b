"""The respond job at size: tasks for all cores, facts of a request made once, no column through Python that nobody reads."""

from dataclasses import replace

from pyspark.sql import functions as F

from vellum.operators.accept import response_checks
from vellum.operators.cascade import expression_scorer
from vellum.operators.normalize import normalize_text
from vellum.operators.prompts import batch_generate
from vellum.operators.quality import request_facts, text_facts
from vellum.plans import catalog as C
from vellum.plans.respond import run_respond
from vellum.plans.stand_ins import echoing_generator

SF = "/root/testdata/sf0.001"
SCORER = expression_scorer(lambda q, t, i: ((F.length(t) * 7 + i) % 100) / 100.0)
#: A pack of few rules: plans are made quickly.
MINI = replace(C.PACK, rules=C.PACK.rules[4:6], response_rules=C.PACK.response_rules[:1], topics=C.PACK.topics[:2], relevance_rules=(),
               intents=(), templates=C.PACK.templates[-1:], boundaries=C.PACK.boundaries[-1:], backstops=C.PACK.backstops[-1:])


def test_every_long_step_has_tasks_for_all_cores(spark):
    """The rows are few bytes, which Spark would merge into one task."""
    r = spark.range(800).selectExpr("id as original_index", "concat('q', id) as id", "concat('Where is file ', id, ' of the archive?') as query")
    run = run_respond(r.coalesce(1), MINI, SCORER, generate_fn=echoing_generator)
    cores = spark.sparkContext.defaultParallelism
    for name in ("drafts", "assessed", "replaced", "final"):
        assert len(run.steps[name].rows.inputFiles()) >= cores, name
    assert run.counters["records"] == run.rows.select("original_index").distinct().count() == 800


def test_checks_by_known_facts_equal_plain_checks(spark):
    odd = spark.createDataFrame([
        (None, None), ("", ""), ("What does NASA say?", "ESA says so, and"), ("漢 how many items in total", "漢字 none."),
        ("translate this with care from that", "That is left to the reader:"), ("which source", "None of the passages at hand settles this"),
        ("password?", "Sorry, I cannot help"), ("example.org?", "See example.net (or www.example")], "query string, response string")
    p = C.mutated_pairs(spark, SF).select("query", "response").unionByName(odd)
    for name, cats in (("UNSAFE", ["secret"]), ("SAFE_SENSITIVE", ["license", "french"]), ("SAFE_DIRECT", [])):
        x = p.withColumns({"route": F.lit(name), "cats": F.array(*[F.lit(c) for c in cats]).cast("array<string>"),
                           "qn": normalize_text("query"), "rn": normalize_text("response")}).localCheckpoint()
        x = x.withColumns({"request": request_facts("query", "qn", "cats", C.PACK), "own": text_facts("response", "rn", C.PACK)})
        plain = response_checks("response", "query", "route", "cats", "qn", "rn", C.PACK)
        known = response_checks("response", "query", "route", "cats", "qn", "rn", C.PACK, request=F.col("request"), own=F.col("own"))
        both = x.select("query", "response", plain.alias("plain"), known.alias("known")).collect()
        assert len(both) > 20 and [r for r in both if r.plain != r.known] == []


def test_generator_returns_the_kept_columns(spark):
    df = spark.range(5).selectExpr("id", "'unread' as other", "array(struct('user' as role, 'a b' as content)) as messages", "300 as max_tokens")
    got = batch_generate(df, echoing_generator, keep=["id"])
    assert got.columns == ["id", "text", "finish_reason"]
    assert sorted((r.id, r.text, r.finish_reason) for r in got.collect()) == [(i, "a b", "stop") for i in range(5)]
    assert batch_generate(df, echoing_generator).columns == [*df.columns, "text", "finish_reason"]
