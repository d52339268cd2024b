"""J8 with a model inside: written steps, restarts, counters observed by the write."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vellum.operators.cascade import expression_scorer, udf_scorer
from vellum.plans import catalog as C
from vellum.plans import stages as S
from vellum.plans.respond import diagnostic_counts, diagnostics, respond, run_respond
from vellum.plans.stages import Stages, content_digest

SF = "/root/testdata/sf0.001"
SCORER = expression_scorer(lambda q, t, i: ((F.length(t) * 7 + i) % 100) / 100.0)
#: A pack of few rules: plans are made quickly.
MINI = replace(C.PACK, rules=C.PACK.rules[4:6], response_rules=C.PACK.response_rules[:1], topics=C.PACK.topics[:2], relevance_rules=(),
               intents=(), templates=C.PACK.templates[-1:], boundaries=C.PACK.boundaries[-1:], backstops=C.PACK.backstops[-1:])
GOOD = "The file lies in the town archive, shelf nine, under its old number."


def requests(spark, n=12):
    return spark.createDataFrame([(i, f"q{i}", f"Where is file {i} of the archive kept today?") for i in range(n)],
                                 "original_index long, id string, query string").repartition(3)


def generator(log, broken=()):
    """Notes every message it is asked, in a file: it runs in worker processes.  ``broken``: kinds or turns that fail."""
    path, good = str(log), GOOD

    def generate(messages, max_tokens):
        out = []
        for m in messages:
            turn = m[-1]["content"]
            kind = "rewrite" if turn.startswith("Question:") else "draft"
            if kind in broken or turn in broken:
                raise RuntimeError("the model went away")
            with open(path, "a") as f:
                f.write(f"{kind}\t{turn!r}\n")
            out.append(good if kind == "rewrite" or " 3 " in turn else "It is on page four and")
        return out, ["stop"] * len(out)
    return generate


def asked(log, kind):
    return [x for x in open(log) if x.startswith(kind)] if os.path.exists(log) else []


def rows(df):
    return sorted((r.original_index, r.stage, r.response, r.draft_text, r.rewrite_text) for r in df.collect())


def test_a_restarted_job_asks_no_model_twice(spark, tmp_path):
    r, log, at = requests(spark), tmp_path / "asked", str(tmp_path / "job")
    with pytest.raises(Exception, match="the model went away"):
        run_respond(r, MINI, SCORER, generate_fn=generator(log, ("rewrite",)), staging=at)
    assert len(asked(log, "draft")) == 12 and not asked(log, "rewrite")
    run = run_respond(r, MINI, SCORER, generate_fn=generator(log), staging=at)
    rejected = run.rows.where("not draft_accepted").count()
    assert len(asked(log, "draft")) == 12 and len(asked(log, "rewrite")) == rejected > 0
    assert run.steps["drafts"].reused and run.steps["assessed"].reused and not run.steps["rewrites"].reused
    again = run_respond(r, MINI, SCORER, generate_fn=generator(log, ("draft", "rewrite")), staging=at)
    assert all(s.reused for s in again.steps.values()) and rows(again.rows) == rows(run.rows)
    assert again.counters == run.counters and run.counters["records"] == 12


def test_killed_after_each_step(spark, tmp_path, monkeypatch):
    """The driver dies right after a step is written, at every step in turn."""
    r, log, at = requests(spark, 8), tmp_path / "asked", str(tmp_path / "job")
    expected = rows(run_respond(r, MINI, SCORER, generate_fn=generator(tmp_path / "other")).rows)
    write, died = S.Stages._write, []

    def dying(self, df, path, counters):
        out = write(self, df, path, counters)
        name = path.rsplit("/", 1)[1].rsplit("-", 1)[0]
        if name not in died:
            died.append(name)
            raise KeyboardInterrupt
        return out

    monkeypatch.setattr(S.Stages, "_write", dying)
    for _ in range(9):
        try:
            got = rows(run_respond(r, MINI, SCORER, generate_fn=generator(log), staging=at).rows)
            break
        except KeyboardInterrupt:
            pass
    assert died == ["drafts", "assessed", "rewrites", "replaced", "final"] and got == expected
    assert len(asked(log, "draft")) == 8 and len(asked(log, "rewrite")) == len([x for x in got if x[4] is not None])


def test_a_half_written_step_is_run_again(spark, tmp_path, monkeypatch):
    at, data = str(tmp_path / "job"), spark.range(10).withColumn("text", F.lit("x"))
    stages = Stages(spark, at)
    data.limit(3).write.parquet(f"{at}/a-{S.digest('a', 1)}/rows")  # no marker
    step = stages.run("a", (1,), lambda cut: data, {"n": F.count(F.lit(1))})
    assert not step.reused and step.rows.count() == 10 and step.counters == {"n": 10}
    assert stages.run("a", (1,), lambda cut: pytest.fail("built again"), {"n": F.count(F.lit(1))}).counters == {"n": 10}
    assert not stages.run("a", (2,), lambda cut: data.limit(0)).reused


def test_slices_are_finished_one_by_one(spark, tmp_path):
    r, log, at = requests(spark, 30), tmp_path / "asked", str(tmp_path / "job")
    bad = "Where is file 7 of the archive kept today?"
    with pytest.raises(Exception, match="the model went away"):
        run_respond(r, MINI, SCORER, generate_fn=generator(log, (bad,)), staging=at, slices=5)
    run = run_respond(r, MINI, SCORER, generate_fn=generator(log), staging=at, slices=5)
    drafts = asked(log, "draft")
    broken = F.pmod(F.xxhash64(F.col("original_index")), F.lit(5))
    part = {x.original_index: x.k for x in r.select("original_index", broken.alias("k")).collect()}
    for i in range(30):
        n = sum(f"file {i} of" in a for a in drafts)
        assert n == 1 if part[i] != part[7] else n >= 1
    assert run.rows.count() == 30 and run.counters["records"] == 30


def test_other_inputs_share_nothing(spark):
    from vellum.operators.guard import Window
    from vellum.plans.respond import Settings, _base
    r, d = requests(spark, 4), spark.createDataFrame([(0, "x", "stop")], "original_index long, text string, finish_reason string")
    base = lambda r=r, d=None, w=None, settings=Settings(), version="", pack=MINI, asks=True: _base(
        r, pack, d, w, settings, "somewhere", version, asks)
    keys = [base(), base(requests(spark, 5)), base(d=d), base(w=d), base(version="new model"), base(settings=Settings(threshold=0.4)),
            base(settings=Settings(window=Window(64))), base(pack=replace(MINI, system_base="other")), base(asks=False)]
    assert len(set(keys)) == len(keys) and base(r.repartition(1)) == keys[0]
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, t string")
    assert content_digest(a) == content_digest(a.select("t", "k").repartition(2).select("k", "t"))
    assert len({content_digest(x) for x in (a, a.union(a), a.limit(1), a.withColumnRenamed("t", "u"), a.limit(0))}) == 5


def test_a_classifier_is_asked_once(spark, tmp_path):
    """With a user model, the cascade's rows go through the tiers alone; a second run asks nothing."""
    log, at = str(tmp_path / "scored"), str(tmp_path / "job")

    def classify(queries, texts):
        with open(log, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        if any("page four" in t for t in texts):
            raise RuntimeError("too long")
        return [0.2] * len(texts)

    r = requests(spark, 6)
    run = run_respond(r, MINI, udf_scorer(classify, batch_size=1), generate_fn=generator(tmp_path / "asked"), staging=at)
    n = len(open(log).readlines())
    c = run.counters
    scored = 6 + c["rewrite_requests"] + sum(c[f"tier{k}_scored"] for k in (1, 2, 3, 4, 6))
    assert n == scored and run.rows.count() == 6
    run_respond(r, MINI, udf_scorer(classify, batch_size=1), generate_fn=generator(tmp_path / "asked"), staging=at)
    assert len(open(log).readlines()) == n


def test_failed_scores_and_views_of_candidates(spark):
    df = spark.createDataFrame([(0, "Please add the numbers 3 and 4 of the list", "The sum of the two numbers is seven.", True),
                                (1, "Another request", "A text.", False)], "original_index long, query string, m string, open boolean")
    from vellum.operators.cascade import guarded_select
    from vellum.operators.normalize import normalize_table
    from vellum.operators.tagging import tag_and_route
    x = tag_and_route(normalize_table(df, "query", "query_norm", "query_compact"), "query_norm", C.PACK, "query_compact")

    def fails(queries, texts):
        raise RuntimeError("no memory")

    got = {g.original_index: g for g in guarded_select(x, C.PACK, udf_scorer(fails), ["m"], when=F.col("open")).collect()}
    assert got[1].selected is None and got[1].tier_counts is None
    s = got[0].selected
    assert s.tier == 6 and s.label == "unknown" and s.error == "no memory"
    assert s.visible.guard_query_total_tokens == 10 and s.visible.estimated_visible_tokens == len(s.text.split())


def test_counters_equal_a_scan(spark):
    run = C.ran(spark, SF)
    assert run.diagnostics().first().asDict() == diagnostics(run.rows, C.PACK).first().asDict()
    assert sorted(map(tuple, run.histograms().collect())) == sorted(map(tuple, diagnostic_counts(run.rows).collect()))


def test_unknown_finish_reasons_are_counted(spark):
    d = spark.createDataFrame([(i, GOOD, "cancelled" if i % 2 else "stop") for i in range(5)], "original_index long, text string, finish_reason string")
    run = run_respond(requests(spark, 5), MINI, SCORER, d)
    assert run.counters["draft_finish_reason=*"] == 2
    assert sorted(map(tuple, run.histograms().collect())) == sorted(map(tuple, diagnostic_counts(run.rows).collect()))


def test_settings_reach_the_steps(spark):
    r, asks = requests(spark, 2), []
    d = spark.createDataFrame([(0, "It is on page four and", None), (1, GOOD, None)], "original_index long, text string, finish_reason string")
    from vellum.operators.guard import Window
    small = {x.original_index: x for x in respond(r, d, MINI, expression_scorer(lambda q, t, i: F.lit(0.1)), window=Window(20, 4)).collect()}
    assert small[1].guard_query_visible_tokens + small[1].estimated_visible_tokens <= 16 and small[1].guard_response_token_budget < 13
    for most, tier in ((0.6, 1), (0.5, None)):
        df = spark.createDataFrame([(0, "q", "Write exactly 3 bullet points in JSON: a shelf list")], "original_index long, id string, query string")
        x = respond(df, spark.createDataFrame([(0, "Shelf 1, shelf 2 and shelf 3 hold the list.", None)], "original_index long, text string, finish_reason string"),
                    MINI, expression_scorer(lambda q, t, i: F.lit(0.55)), benign_max_probability=most).first()
        asks.append(x.selected.tier)
        assert (x.selected.tier == 1) == (tier == 1)
    assert len(asks) == 2
    with pytest.raises(ValueError, match="drafts or a generator"):
        respond(r, None, MINI, SCORER)


def test_candidates_of_a_builder(spark):
    """A caller's candidates take the place of the templates, in their order, relevant ones first to be scored."""
    own = lambda q, route, cats: F.array(F.lit(None).cast("string"), F.lit("Cut off and"), F.concat(F.lit("The answer to your question lies on shelf "), F.length(q), F.lit(".")))
    r = requests(spark, 2)
    d = spark.createDataFrame([(0, "It is on page four and", None), (1, "It is on page five and", None)], "original_index long, text string, finish_reason string")
    got = respond(r, d, MINI, expression_scorer(lambda q, t, i: F.lit(0.1)), builder=own).collect()
    assert {x.response for x in got} == {"The answer to your question lies on shelf 42."}
    assert {(x.selected.tier, x.selected.position) for x in got} == {(3, 2)}


def test_steps_can_be_discarded(spark, tmp_path):
    from vellum.session import MADE, discard_staged, staged
    kept, gone = staged(spark.range(3), "kept"), Stages(spark)
    step = gone.run("a", (1,), lambda cut: spark.range(5))
    assert step.rows.count() == 5 and os.path.isdir(gone.root)
    assert discard_staged(spark, gone.root) == 1 and not os.path.exists(gone.root) and kept.count() == 3
    own = Stages(spark, str(tmp_path / "own"))
    own.run("a", (1,), lambda cut: spark.range(5))
    assert discard_staged(spark, own.root) == 0 and os.path.isdir(own.root)  # a caller's folder is the caller's
    assert gone.root not in MADE[spark.sparkContext.applicationId]


def test_generator_batches_and_set_up(spark, tmp_path):
    """One set-up a worker; calls of so many rows over the borders of Arrow batches, in order."""
    from vellum.operators.prompts import batch_generate
    log = str(tmp_path / "log")

    def setup():
        with open(log, "a") as f:
            f.write("setup\n")

        def generate(messages, max_tokens):
            with open(log, "a") as f:
                f.write(f"{len(messages)}\n")
            return [m[-1]["content"].upper() for m in messages], None if max_tokens[0] % 2 else ["stop"] * len(messages)
        return generate

    df = spark.range(50).selectExpr("id", "array(struct('user' as role, concat('t', id) as content)) as messages", "cast(id as int) as max_tokens").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = batch_generate(df, setup_fn=setup, batch_size=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.text) for r in got] == [(i, f"T{i}") for i in range(50)] and {r.finish_reason for r in got} == {"stop"}
    assert open(log).read().split() == ["setup", "16", "16", "16", "2"]
    with pytest.raises(ValueError, match="either a generator or its set-up"):
        batch_generate(df)
    made = generator(tmp_path / "asked")
    run = run_respond(requests(spark, 3), MINI, SCORER, generate_setup=lambda: made, generate_batch=2)
    assert run.rows.count() == 3 and len(asked(tmp_path / "asked", "draft")) == 3
