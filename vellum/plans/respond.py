"""J8 respond: requests + drafts (+ rewrites) -> final responses, decisions, diagnostics.

The job has steps that can be run apart, with a model between them:

  assess_drafts      join requests and drafts (the one shuffle), clean, score, decide
  rewrite_requests   rejected rows with their reason and the messages for a model
  merge_rewrites     join the rewrites, clean, score and decide the rejected rows
  replace_rejected   the cascade for rows that are still rejected
  finalize           last quality gate, backstop, decision columns

Everything after a join is row-local: a row that needs a step less carries
nulls through it.  ``run_respond`` runs all steps, asks a generator for drafts and
rewrites that are not given, and writes every step that asks a model; a job that
is started again reads what is written and asks no model twice (``stages``).
The run's counters are observed by the write of the final rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.accept import R_LOW_VISIBILITY, decide, response_checks
from vellum.operators.cascade import STAGES, counter_columns, fallback_candidates, guarded_select, max_variant
from vellum.operators.guard import VISIBILITY_FIELDS, Window
from vellum.operators.normalize import normalize_steps, normalize_table, unescape_nfkc
from vellum.operators.prompts import batch_generate, generation_messages, rewrite_messages
from vellum.operators.quality import clean_and_repair, request_facts, text_facts
from vellum.operators.tagging import ROUTES, helpfulness_priority, requires_direct_answer, tag_and_route
from vellum.packs import Pack
from vellum.plans.stages import Stages, Step, content_digest, digest
from vellum.session import discard_staged, spread


def _one_each(answers: DataFrame, name: str, max_chars: int | None) -> DataFrame:
    """``original_index`` and the cleaned and repaired answer; a second answer to a request fails the job.

    Cleaning comes before the join with the requests: Spark plans Python steps
    that only projections lie between into one expression, and the join parts them."""
    per = spread(answers, "original_index").groupBy("original_index").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("text", "finish_reason")).alias("a"))
    twice = F.raise_error(F.concat(F.lit(f"more than one {name} for request "), F.col("original_index").cast("string")))
    per = per.select("original_index", F.when(F.col("n") > 1, twice.cast("string")).otherwise(F.col("a.text")).alias("_raw"),
                     F.coalesce("a.finish_reason", F.lit("unknown")).alias(f"{name}_finish_reason"))
    return clean_and_repair(per, "_raw", f"{name}_finish_reason", name, max_chars).drop("_raw")


@dataclass(frozen=True)
class Settings:
    """What a run may be set to.  ``rewrite_tokens``: token limit of every rewrite; null keeps the route's."""

    max_chars: int | None = None
    threshold: float = 0.5
    min_visible: int = 0
    preserve_max_visible: int = 0
    benign_max_probability: float = 0.60
    rewrite_tokens: int | None = None
    window: Window = field(default_factory=Window)
    #: Fallback candidates in place of the pack's templates: (query, route name, categories) -> array of texts.
    builder: Callable[[Column, Column, Column], Column] | None = None

    def key(self) -> tuple:
        """All that counts but the tokenizer and the builder, which have no name: ``version`` of the run stands for them."""
        return (self.max_chars, self.threshold, self.min_visible, self.preserve_max_visible, self.benign_max_probability,
                self.rewrite_tokens, *self.window.numbers())


def _judge(x: DataFrame, name: str, pack: Pack, scorer, threshold: float, min_visible: int, reject_meta: bool,
           when: Column | None = None, window: Window = Window()) -> DataFrame:
    """Score ``<name>_text`` and decide on it (F1), for the rows of ``when``."""
    text, on = F.col(f"{name}_text"), F.lit(True) if when is None else when
    x = x.withColumns({f"{name}_plain": unescape_nfkc(F.when(on, text)),
                       f"_{name}_a": scorer(F.col("query"), F.when(on, F.array(text)).otherwise(F.array().cast("array<string>")),
                                            F.col("original_index"))})
    x = x.withColumn("_norm", normalize_steps(F.col(f"{name}_plain"), None))
    x = x.withColumns({"_request": F.when(on, request_facts("query", "query_norm", "categories", pack)),
                       "_own": F.when(on, text_facts(text, "_norm", pack))})
    a = F.try_element_at(f"_{name}_a", F.lit(1))
    visible = window.seen("query", text)["estimated_visible_tokens"]
    x = x.withColumns({f"{name}_label": F.when(on, F.coalesce(a["label"], F.lit("unknown"))),
                       f"{name}_harmful_probability": F.when(on, F.coalesce(a["prob"], F.lit(1.0))),
                       f"{name}_guard_visible_response_tokens": F.when(on, visible),
                       "_checks": F.when(on, response_checks(text, "query", "route_name", "categories", "query_norm",
                                                            "_norm", pack, F.col(f"{name}_incomplete"),
                                                            F.col("_request"), F.col("_own")))})
    prio = helpfulness_priority("route_name", "categories", pack)
    low = prio & (F.col(f"{name}_guard_visible_response_tokens") < min_visible)
    x = x.withColumn("_f1", F.when(on, decide(F.col("_checks"), f"{name}_label", f"{name}_harmful_probability", prio,
                                              reject_meta, low, threshold)))
    return x.withColumns({f"{name}_accepted": F.coalesce("_f1.accepted", F.lit(False)),
                          f"{name}_reason": F.col("_f1.reason")}).drop("_f1", "_checks", f"_{name}_a", "_norm", "_request", "_own")


def assess_drafts(requests: DataFrame, drafts: DataFrame, pack: Pack, scorer, max_chars: int | None = None,
                  threshold: float = 0.5, min_visible: int = 0, window: Window = Window()) -> DataFrame:
    """Requests with their draft, cleaned, scored and decided on.

    A request without a draft, with two of them, or with a draft that is blank
    once it is cleaned fails the job and is named (A8)."""
    x = routed(requests, pack).join(_one_each(drafts, "draft", max_chars), "original_index", "left")

    def refuse(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{why} model draft for id "), F.col("id"))).cast("string")

    x = x.withColumn("draft_text", F.when(F.col("draft_text").isNull(), refuse("no"))
                     .when(T.unicode_strip("draft_text") == "", refuse("blank")).otherwise(F.col("draft_text")))
    return _judge(x, "draft", pack, scorer, threshold, min_visible, False, window=window)


def routed(requests: DataFrame, pack: Pack) -> DataFrame:
    """Requests, normalized, tagged and routed."""
    r = spread(requests.select("original_index", "id", "query"), "original_index")
    r = normalize_table(r, "query", "query_norm", "query_compact")
    return tag_and_route(r, "query_norm", pack, "query_compact").drop("query_compact")


def draft_requests(requests: DataFrame, pack: Pack) -> DataFrame:
    """D3: what to ask a model for every request -- key, messages, token limit."""
    return routed(requests, pack).select(
        "original_index", "id", generation_messages("query", "route_name", "categories", pack).alias("messages"),
        F.col("route.max_tokens").alias("max_tokens"))


def rewrite_requests(assessed: DataFrame, pack: Pack, max_tokens: int | None = None) -> DataFrame:
    """F2 + D4: what to ask a model for the rejected drafts -- key, reason, messages, token limit."""
    messages = rewrite_messages("query", "draft_text", "route_name", "categories", "draft_reason", pack)
    return assessed.where(~F.col("draft_accepted")).select(
        "original_index", "id", F.col("draft_reason").alias("reason"), messages.alias("messages"),
        (F.col("route.max_tokens") if max_tokens is None else F.lit(max_tokens)).alias("max_tokens"))


def merge_rewrites(assessed: DataFrame, rewrites: DataFrame | None, pack: Pack, scorer, max_chars: int | None = None,
                   threshold: float = 0.5, min_visible: int = 0, window: Window = Window()) -> DataFrame:
    """one rewrite round for the rejected drafts.  A missing rewrite counts as an empty one; without
    a table of rewrites there is no round, and every rejected draft needs a replacement."""
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    if rewrites is None:
        return assessed.withColumns({
            "rewrite_text": text, "rewrite_plain": text, "rewrite_finish_reason": text, "rewrite_repaired": flag,
            "rewrite_incomplete": flag, "rewrite_label": text, "rewrite_harmful_probability": F.lit(None).cast("double"),
            "rewrite_guard_visible_response_tokens": F.lit(None).cast("int"), "rewrite_accepted": F.lit(False),
            "rewrite_reason": text, "needs_fallback": ~F.col("draft_accepted")})
    asked = ~F.col("draft_accepted")
    x = spread(assessed, "original_index").join(_one_each(rewrites, "rewrite", max_chars), "original_index", "left")
    empty = {"text": F.lit(""), "finish_reason": F.lit("unknown"), "repaired": F.lit(False), "incomplete": F.lit(True)}
    x = x.withColumns({f"rewrite_{c}": F.when(asked, F.coalesce(F.col(f"rewrite_{c}"), v)) for c, v in empty.items()})
    x = _judge(x, "rewrite", pack, scorer, threshold, min_visible, True, asked, window)
    return x.withColumn("rewrite_accepted", F.col("rewrite_accepted") & F.coalesce(F.col("rewrite_text") != "", F.lit(False))
                        ).withColumn("needs_fallback", asked & ~F.col("rewrite_accepted"))


def replace_rejected(merged: DataFrame, pack: Pack, scorer, threshold: float = 0.5, preserve_max_visible: int = 0,
                     benign_max_probability: float = 0.60, window: Window = Window(), **more) -> DataFrame:
    """J7 for the rows that are still rejected; ``chosen`` and its stage for all."""
    x = guarded_select(merged, pack, scorer, ["rewrite_text", "draft_text"], threshold=threshold, window=window,
                       benign_max_probability=benign_max_probability, unescaped=["rewrite_plain", "draft_plain"],
                       preserve_max_visible=preserve_max_visible, when=F.col("needs_fallback"), **more)
    accepted = F.when(F.col("draft_accepted"), F.col("draft_text")).when(F.col("rewrite_accepted"), F.col("rewrite_text"))
    stage = F.when(F.col("draft_accepted"), "draft_accepted").when(F.col("rewrite_accepted"), "rewrite_accepted")
    return x.drop("backstop", "first_candidate").withColumns({
        "chosen": F.coalesce(accepted, F.col("selected.text")), "stage_before": F.coalesce(stage, F.col("selected.stage"))})


def finalize(x: DataFrame, pack: Pack, max_chars: int | None = None, window: Window = Window(), builder=None) -> DataFrame:
    """last quality gate, backstop replacement (which asks no model), decision columns."""
    x = clean_and_repair(spread(x, "original_index"), "chosen", None, "final", max_chars)
    issues = {"_inc": F.col("final_incomplete") | (F.col("final_text") == ""),
              "_han": T.has_unexpected_script("final_text", "query"),
              "_meta": (F.col("stage_before") == "rewrite_accepted") & T.has_rewrite_meta(
                  "final_text", list(pack.rewrite_meta_patterns))}
    x = x.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in issues.items()})
    x = x.withColumn("final_quality_reason", F.array_join(F.array_compact(F.array(
        F.when(F.col("_inc"), F.lit("incomplete final response")), F.when(F.col("_han"), F.lit("unexpected Han characters")),
        F.when(F.col("_meta"), F.lit("rewrite meta leakage")))), ", "))
    x = x.withColumn("_failed", F.col("final_quality_reason") != "")
    x = fallback_candidates(x, pack, when=F.col("_failed"), builder=builder)
    x = x.withColumns({
        "response": F.when(~F.col("_failed"), F.col("final_text"))
                     .otherwise(F.when(F.col("backstop") != "", F.col("backstop")).otherwise(F.col("first_candidate"))),
        "stage": F.when(F.col("_failed"), F.lit("final_quality_backstop")).otherwise(F.col("stage_before")),
        "stage_before_final_quality": F.when(F.col("_failed"), F.col("stage_before")),
        "final_quality_reason": F.when(F.col("_failed"), F.col("final_quality_reason")),
        "final_completion_issue": F.col("_inc"), "final_han_issue": F.col("_han"), "final_meta_issue": F.col("_meta"),
    })
    direct = requires_direct_answer("route_name", "categories", pack)
    x = x.withColumn("final_helpfulness_issue", F.when(T.over_refusal("response", list(pack.nonanswer_patterns), direct),
                                                       F.lit("generic or excessive refusal")))
    x = x.withColumn("_visible", window.seen("query", "response"))
    return x.withColumns({c: F.col(f"_visible.{c}") for c in VISIBILITY_FIELDS}).drop(
        "_inc", "_han", "_meta", "_failed", "_visible", "candidates", "_back", "backstop", "first_candidate")


@dataclass(frozen=True)
class Run:
    """A finished job: its rows, counters observed while they were written, and its steps."""

    rows: DataFrame
    pack: Pack
    counters: dict
    steps: dict[str, Step]
    folder: str

    def discard(self) -> bool:
        """Delete the written steps of a run without a ``staging`` of its own, once its rows are saved elsewhere."""
        return discard_staged(self.rows.sparkSession, self.folder) > 0

    def diagnostics(self) -> DataFrame:
        """G3 + G10, equal to ``diagnostics`` of the rows, without reading them."""
        names = list(diagnostic_columns(self.pack))
        return self.rows.sparkSession.createDataFrame([tuple(self.counters[n] for n in names)], ", ".join(f"`{n}` long" for n in names))

    def histograms(self) -> DataFrame:
        """G1/G2/G4, equal to ``diagnostic_counts`` of the rows; they are read only for values that no table names."""
        found, open_ = [], []
        for counter, values in histogram_values(self.pack).items():
            found += [(counter, v, self.counters[f"{counter}={v}"]) for v in values if self.counters[f"{counter}={v}"]]
            if self.counters[f"{counter}=*"]:
                open_.append((counter, values))
        out = self.rows.sparkSession.createDataFrame(found, "counter string, value string, n long")
        if open_:
            rest = F.lit(False)
            for counter, values in open_:
                rest = rest | ((F.col("counter") == counter) & ~F.col("value").isin(*values))
            out = out.unionByName(diagnostic_counts(self.rows).where(rest))
        return out


def _replaced(requests: DataFrame, pack: Pack, scorer, drafts, rewrites, generate_fn, settings: Settings, stages: Stages,
              base: str, slices: int) -> dict[str, Step]:
    """The written steps up to the replaced rows."""
    steps: dict[str, Step] = {}
    common = dict(max_chars=settings.max_chars, threshold=settings.threshold, min_visible=settings.min_visible, window=settings.window)

    def generated(name: str, after: str, asked: DataFrame) -> DataFrame:
        steps[name] = stages.run(name, (after,), lambda cut: generate_fn(cut(asked)).select(
            "original_index", "text", "finish_reason"), slices=slices, slice_by="original_index")
        return steps[name].rows

    if drafts is None:
        if generate_fn is None:
            raise ValueError("either drafts or a generator")
        drafts = generated("drafts", base, draft_requests(requests, pack))
    steps["assessed"] = stages.run("assessed", (base,), lambda cut: assess_drafts(requests, drafts, pack, scorer, **common))
    assessed = steps["assessed"].rows
    if rewrites is None and generate_fn is not None:
        rewrites = generated("rewrites", steps["assessed"].digest, rewrite_requests(assessed, pack, settings.rewrite_tokens))
    merged, more = merge_rewrites(assessed, rewrites, pack, scorer, **common), {"builder": settings.builder}
    if getattr(scorer, "is_model", False):
        steps["merged"] = stages.run("merged", (steps["assessed"].digest,), lambda cut: merged)
        merged = steps["merged"].rows

        def tier(rows: DataFrame, name: str) -> DataFrame:
            steps[f"cascade_{name}"] = stages.run(f"cascade_{name}", (steps["assessed"].digest,), lambda cut: rows)
            return steps[f"cascade_{name}"].rows
        more["stage"] = tier
    steps["replaced"] = stages.run("replaced", (steps["assessed"].digest,), lambda cut: replace_rejected(
        merged, pack, scorer, settings.threshold, settings.preserve_max_visible, settings.benign_max_probability, settings.window, **more))
    return steps


def _asker(generate_fn: Callable | None, setup_fn: Callable | None = None, batch_size: int | None = None) -> Callable | None:
    """From a table of messages to its answers, if there is a generator."""
    if generate_fn is None and setup_fn is None:
        return None
    return lambda asked: batch_generate(asked, generate_fn, setup_fn=setup_fn, batch_size=batch_size, keep=["original_index"])


def _base(requests, pack: Pack, drafts, rewrites, settings: Settings, staging: str | None, version: str, generates: bool) -> str:
    """Digest of everything that the steps follow from; nothing is read if there is nothing to resume."""
    if staging is None:
        return "new"
    tables = [content_digest(t) if t is not None else None for t in (requests.select("original_index", "id", "query"), drafts, rewrites)]
    return digest(*tables, repr(pack), settings.key(), version, generates)


def run_respond(requests: DataFrame, pack: Pack, scorer, drafts: DataFrame | None = None, rewrites: DataFrame | None = None,
                generate_fn: Callable | None = None, settings: Settings = Settings(), staging: str | None = None,
                version: str = "", slices: int = 1, generate_setup: Callable[[], Callable] | None = None,
                generate_batch: int | None = None) -> Run:
    """J8 to the end: one written row per request, and the run's counters.

    ``generate_fn(messages, max_tokens) -> (texts, finish_reasons)`` makes the drafts and the
    rewrites that are not given; without it, drafts are a must and no rewrites mean no round.
    ``generate_setup`` makes it once in each worker instead, ``generate_batch`` rows go into one
    call (see ``batch_generate``).
    With ``staging`` a job that was killed goes on where it was: finished steps are read, and
    of a generating step only unfinished ones of its ``slices`` are asked for again.  Steps
    are shared by runs with equal tables, pack and settings; give ``version`` another value when
    the generator, the classifier, the tokenizer or the builder changes.
    """
    spark = requests.sparkSession
    stages = Stages(spark, staging)
    ask = _asker(generate_fn, generate_setup, generate_batch)
    base = _base(requests, pack, drafts, rewrites, settings, staging, version, ask is not None)
    steps = _replaced(requests, pack, scorer, drafts, rewrites, ask, settings, stages, base, slices)
    counters = {**diagnostic_columns(pack), **histogram_columns(pack)}
    steps["final"] = stages.run("final", (steps["replaced"].digest,), lambda cut: finalize(
        steps["replaced"].rows, pack, settings.max_chars, settings.window, settings.builder), counters)
    return Run(steps["final"].rows, pack, steps["final"].counters, steps, stages.root)


def respond(requests: DataFrame, drafts: DataFrame | None, pack: Pack, scorer, rewrites: DataFrame | None = None,
            max_chars: int | None = None, threshold: float = 0.5, min_visible: int = 0,
            preserve_max_visible: int = 0, staging: str | None = None, generate_fn: Callable | None = None,
            version: str = "", slices: int = 1, **settings) -> DataFrame:
    """One row per request with ``response``, ``stage`` and the decision fields.

    Steps are written under ``staging``, where a restart finds them, or in the shared folder of
    the session; those writes are the only jobs that run here.  The last step is left to the
    caller; ``run_respond`` writes it too and has the counters.  See there for the rest;
    ``settings`` are more fields of Settings."""
    own = Settings(max_chars, threshold, min_visible, preserve_max_visible, **settings)
    ask = _asker(generate_fn)
    base = _base(requests, pack, drafts, rewrites, own, staging, version, ask is not None)
    steps = _replaced(requests, pack, scorer, drafts, rewrites, ask, own, Stages(requests.sparkSession, staging), base, slices)
    return finalize(steps["replaced"].rows, pack, max_chars, own.window, own.builder)


def decisions(final: DataFrame, *more: str) -> DataFrame:
    """one decision row per request, with ``more`` columns of the run."""
    return final.select(
        "original_index", "id", "route_name", "categories", F.col("route.reason").alias("route_reason"), "stage",
        "draft_finish_reason", "draft_label", "draft_harmful_probability", "draft_reason",
        "draft_guard_visible_response_tokens", "rewrite_finish_reason", "rewrite_label",
        "rewrite_harmful_probability", "rewrite_reason", "rewrite_guard_visible_response_tokens",
        F.col("selected.position").alias("fallback_candidate_position"),
        F.col("selected.label").alias("fallback_label"), F.col("selected.prob").alias("fallback_harmful_probability"),
        F.col("selected.reason").alias("fallback_reason"), "stage_before_final_quality", "final_quality_reason",
        "final_helpfulness_issue", *VISIBILITY_FIELDS, *more)


#: Reasons that diagnostics count for drafts and rewrites: name of the counter, decision reason.
REJECTIONS = {"han_rejected": "response contains unexpected Han characters",
              "over_refusal_rejected": "answerable intent received a generic refusal",
              "visibility_overrides": R_LOW_VISIBILITY}
EITHER = {"relevance_rejections": "response does not match requested task or topic",
          "entity_preservation_rejections": "response changed or omitted an input acronym"}


def diagnostics(final: DataFrame, pack: Pack) -> DataFrame:
    """G3 + G10: the run's scalar counters, one aggregation pass over narrow columns."""
    return final.agg(*[c.alias(n) for n, c in diagnostic_columns(pack).items()])


def diagnostic_columns(pack: Pack) -> dict[str, Column]:
    """The counters of ``diagnostics`` by name, aggregates over final rows."""
    c = F.col
    issue = lambda name: F.count_if(c(name))
    return {
        "records": F.count(F.lit(1)),
        "rewrite_requests": F.count_if(~c("draft_accepted")),
        "final_fallbacks": issue("needs_fallback"),
        "draft_truncation_repaired": issue("draft_repaired"),
        "draft_truncation_unresolved": issue("draft_incomplete"),
        "rewrite_truncation_repaired": issue("rewrite_repaired"),
        "rewrite_truncation_unresolved": issue("rewrite_incomplete"),
        **{f"{who}_{name}": F.count_if(c(f"{who}_reason") == reason)
           for who in ("draft", "rewrite") for name, reason in REJECTIONS.items()},
        "rewrite_meta_rejected": F.count_if(c("rewrite_reason") == "rewrite returned internal evaluation text"),
        **{name: F.count_if(c("draft_reason") == reason) + F.count_if(c("rewrite_reason") == reason)
           for name, reason in EITHER.items()},
        **counter_columns(),
        "fallback_safe_backstop_guard_passed": issue("backstop_guard_passed"),
        "fallback_candidates_unresolved": F.count_if(c("needs_fallback") & (c("selected.tier") == 6)),
        "fallback_selected_by_min_probability": F.count_if(c("selected.tier") == 1),
        "final_quality_backstops": F.count_if(c("stage") == "final_quality_backstop"),
        "final_completion_repaired": issue("final_repaired"),
        "final_completion_issues_detected": issue("final_completion_issue"),
        "final_han_issues_detected": issue("final_han_issue"),
        "final_meta_issues_detected": issue("final_meta_issue"),
        "final_rewrite_meta_leakage": F.count_if((c("stage") == "rewrite_accepted") & T.has_rewrite_meta(
            "response", list(pack.rewrite_meta_patterns))),
        "final_han_contamination": F.count_if(T.has_unexpected_script("response", "query")),
        "likely_truncated": F.count_if(T.incomplete_ending("response", quick=True)),
        "final_over_refusal_detected": F.count_if(c("final_helpfulness_issue").isNotNull()),
        "guard_response_visibility_zero": F.count_if(c("estimated_visible_tokens") == 0),
        "guard_response_visibility_le_5": F.count_if(c("estimated_visible_tokens") <= 5),
    }


#: Columns of the histograms that have one value a row.
HISTOGRAMS = {"route": "route_name", "draft_finish_reason": "draft_finish_reason", "rewrite_finish_reason": "rewrite_finish_reason",
              "fallback_candidate_position": "selected.position", "stage": "stage"}


def histogram_values(pack: Pack) -> dict[str, list[str]]:
    """Values that a run's histograms are known to have; finish reasons may have others."""
    reasons = ["stop", "length", "unknown"]
    return {"route": list(ROUTES), "draft_finish_reason": reasons, "rewrite_finish_reason": reasons,
            "fallback_candidate_position": [str(i) for i in range(max(2, max_variant(pack)) + 1)],
            "stage": ["draft_accepted", "rewrite_accepted", *STAGES.values(), "final_quality_backstop"],
            "category": [*pack.categories(), *(["jailbreak"] if "jailbreak" not in pack.categories() else [])]}


def histogram_columns(pack: Pack) -> dict[str, Column]:
    """Counts of the known values, ``counter=value``, and of all others, ``counter=*``."""
    out = {}
    for counter, values in histogram_values(pack).items():
        if counter == "category":
            out |= {f"category={v}": F.count_if(F.array_contains("categories", v)) for v in values}
            out["category=*"] = F.sum(F.size(F.array_except("categories", F.array(*[F.lit(v) for v in values]))).cast("long"))
        else:
            x = F.col(HISTOGRAMS[counter]).cast("string")
            out |= {f"{counter}={v}": F.count_if(x == v) for v in values}
            out[f"{counter}=*"] = F.count_if(~x.isin(*values))
    return out


def diagnostic_counts(final: DataFrame) -> DataFrame:
    """The run's histograms in one pass -- ``counter``, ``value``, ``n``.

    Counters: route, category, draft and rewrite finish reason, fallback position, stage."""
    text = lambda x: F.col(x).cast("string")
    pairs = F.concat(
        F.array(*[F.struct(F.lit(name).alias("counter"), text(column).alias("value")) for name, column in HISTOGRAMS.items()]),
        F.transform("categories", lambda x: F.struct(F.lit("category").alias("counter"), x.alias("value"))))
    return (final.select(F.explode(pairs).alias("p")).where("p.value is not null")
            .groupBy("p.counter", "p.value").agg(F.count(F.lit(1)).alias("n")))


def stage_counts(final: DataFrame) -> DataFrame:
    """G1: rows per final stage."""
    return final.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
