"""J7 guarded_select: the six-tier replacement cascade.

A request's candidates stay in its row, as small arrays that the pack and the
number of model answers bound: no explode, no regroup, no shuffle.  One lambda
examines the candidates of all tiers; the tiers are projected one after another
and take theirs, if a row is still open.  A user model gets exactly the
candidates of the tiers that a row reaches, which is what the ``scored``
counters (F13) count.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from vellum.functions import text as T
from vellum.operators.accept import decide, response_checks, sound
from vellum.operators.guard import VISIBILITY_FIELDS, Window
from vellum.operators.normalize import normalize_steps, normalized_literal, unescape_nfkc
from vellum.operators.quality import relevant, request_facts, text_facts
from vellum.operators.tagging import helpfulness_priority
from vellum.packs import Pack
from vellum.session import staged

# Stage names and tier reasons, equal to the reference's.
STAGES = {1: "benign_model_recovered", 2: "model_boundary_accepted", 3: "fallback_accepted",
          4: "fallback_boundary_accepted", 5: "fallback_context_preserved", 6: "fallback_safe_backstop"}
R_BENIGN = ("recovered deterministic-safe answer to an ordinary math or constrained-format task "
            "after a low-confidence classifier rejection")
R_PRESERVED = ("preserved contextual answer after all guard candidates failed with insufficient "
               "response visibility")

ASSESSMENT = StructType([StructField("label", StringType()), StructField("prob", DoubleType()), StructField("error", StringType())])


# ------------------------------------------------------------- pack compiled
def _overlap(cats: Column, names) -> Column:
    return F.arrays_overlap(cats, F.array(*[F.lit(n) for n in names])).eqNullSafe(True)


def _route_ok(route: Column, cond: str | None) -> Column:
    if cond is None:
        return F.lit(True)
    if cond == "not_unsafe":
        return route != "UNSAFE"
    return route == cond


def _first(rules, value_of) -> Column:
    chain = None
    for cond, value in rules:
        chain = F.when(cond, value_of(value)) if chain is None else chain.when(cond, value_of(value))
    return chain


def intent(route: Column, cats: Column, pack: Pack) -> Column:
    """F4 intent priority: first intent whose categories are present, else ``route:<ROUTE>``."""
    chain = _first([(_overlap(cats, names) & _route_ok(route, cond), name) for name, names, cond in pack.intents],
                   F.lit)
    fallback = F.concat(F.lit("route:"), route)
    return fallback if chain is None else chain.otherwise(fallback)


def template_slots(intent_col: Column, query_norm: Column, pack: Pack, k: int) -> list[Column]:
    """The k texts of the first matching variant of the row's intent (null past its end), each
    with its normalized form, a constant of the plan."""
    slots = []
    for j in range(k):
        rules = [((intent_col == key) & (T.has_any(query_norm, list(kw)) if kw else F.lit(True)),
                  texts[j] if j < len(texts) else None) for key, kw, texts in pack.templates]
        slots.append(_first(rules, lambda v: F.lit(None).cast("struct<text:string,norm:string>") if v is None else
                            F.struct(F.lit(v).alias("text"), normalized_literal(v).alias("norm"))))
    return slots


def boundary(route: Column, cats: Column, pack: Pack) -> Column:
    """boundary sentence for composite candidates."""
    return _first([((_overlap(cats, n) if n else F.lit(True)) & _route_ok(route, c), t)
                   for n, c, t in pack.boundaries], F.lit).otherwise(F.lit(""))


def backstop_rule(route: Column, cats: Column, pack: Pack, value_of=F.lit) -> Column:
    """the pack's safe closing text for the row."""
    return _first([((_overlap(cats, n) if n else F.lit(True)) & _route_ok(route, c), t)
                   for n, c, t in pack.backstops], value_of).otherwise(value_of(""))


def max_variant(pack: Pack) -> int:
    return max((len(t) for _k, _w, t in pack.templates), default=0)


# ------------------------------------------------------------------ scorers
def expression_scorer(prob_fn: Callable[[Column, Column, Column], Column],
                      label_fn: Callable[[Column, Column], Column] | None = None, threshold: float = 0.5):
    """Scorer from column expressions: ``prob_fn(query, text, index) -> double``.

    A scorer takes (query, array of texts, index) and returns an array of assessments, null for a null text."""
    def scorer(query: Column, texts: Column, index: Column) -> Column:
        def one(t):
            p = prob_fn(query, t, index).cast("double")
            lab = label_fn(t, p) if label_fn else F.when(p >= threshold, "harmful").otherwise("safe")
            return F.when(t.isNotNull(), F.struct(lab.alias("label"), p.alias("prob"), F.lit(None).cast("string").alias("error")))
        return F.transform(texts, one)
    return scorer


def udf_scorer(classify_fn: Callable[[list[str], list[str]], list[float]], batch_size: int = 16,
               threshold: float = 0.5):
    """Scorer calling a user model on Arrow batches.  Null texts are skipped; a
    failing chunk is marked unknown with p = 1.0 and the error's text (per-batch isolation)."""
    @pandas_udf(ArrayType(ASSESSMENT))
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        asked = [(row, j, q or "", t) for row, (q, arr) in enumerate(zip(queries, texts))
                 for j, t in enumerate(arr if arr is not None else []) if t is not None]
        out = [[None] * (len(a) if a is not None else 0) for a in texts]
        for start in range(0, len(asked), batch_size):
            chunk = asked[start:start + batch_size]
            try:
                probs = [float(p) for p in classify_fn([c[2] for c in chunk], [c[3] for c in chunk])]
                if len(probs) != len(chunk):
                    raise ValueError("classifier returned a different number of scores")
                found = [{"label": "harmful" if p >= threshold else "safe", "prob": p, "error": None} for p in probs]
            except Exception as exc:  # noqa: BLE001 - per-batch isolation
                found = [{"label": "unknown", "prob": 1.0, "error": str(exc)} for _ in chunk]
            for (row, j, _q, _t), res in zip(chunk, found):
                out[row][j] = res
        return pd.Series(out)

    def scorer(query: Column, texts: Column, index: Column) -> Column:
        return score(query, texts)
    scorer.is_model = True
    return scorer


# --------------------------------------------------------------- the operator
PLAIN = "array<struct<idx:int,text:string,norm:string>>"


def fallback_candidates(df: DataFrame, pack: Pack, query: str = "query", query_norm: str = "query_norm",
                        route_name: str = "route_name", categories: str = "categories", when: Column | None = None,
                        builder: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """F4-F6 without any scorer: adds ``candidates`` (relevant template texts of the row's intent in
    order, else the backstop; idx, text, norm, relevant), ``backstop`` and ``first_candidate``.

    ``builder(query, route name, categories)`` gives an array of texts in place of the pack's
    templates; they are taken as plain NFKC text, null ones are left out."""
    qn, route, cats = F.col(query_norm), F.col(route_name), F.col(categories)
    when = F.lit(True) if when is None else when
    x = df.withColumns({"_need": when, "_intent": intent(route, cats, pack)})
    x = x.withColumn("_request", F.when(F.col("_need"), request_facts(query, query_norm, categories, pack)))
    own = backstop_rule(route, cats, pack, lambda t: F.struct(F.lit(t).alias("text"), normalized_literal(t).alias("norm")))
    slots = F.array(*template_slots(F.col("_intent"), qn, pack, max_variant(pack))) if builder is None else F.transform(
        builder(F.col(query), route, cats), lambda t: F.when(t.isNotNull(), F.struct(t.alias("text"), normalize_steps(t, None).alias("norm"))))
    x = x.withColumns({"_own": F.when(F.col("_need"), own), "_slots": F.when(F.col("_need"), slots)})

    # the row's own closing text stands behind its templates as number 0, so that one lambda judges all
    tagged = F.concat(F.transform("_slots", lambda c, i: F.struct((i + 1).cast("int").alias("idx"), c.alias("c"))),
                      F.transform(F.array("_own"), lambda c: F.struct(F.lit(0).alias("idx"), c.alias("c"))))
    x = x.withColumn("_slots", F.filter("_slots", lambda c: c.isNotNull()))
    known = F.transform(tagged, lambda t: F.struct(t["idx"].alias("idx"), t["c"].alias("c"), text_facts(t["c"]["text"], t["c"]["norm"], pack).alias("own")))
    x = x.withColumn("_judged", F.transform(known, lambda t: F.struct(
        t["idx"].alias("idx"), t["c"]["text"].alias("text"), t["c"]["norm"].alias("norm"),
        relevant(t["c"]["text"], t["c"]["norm"], query_norm, categories, pack, request=F.col("_request"), own=t["own"]).alias("relevant"))))
    x = x.withColumn("_slots", F.filter("_judged", lambda c: (c["idx"] > 0) & c["relevant"]))
    x = x.withColumn("_fit", F.filter("_slots", lambda c, i: ~F.exists(F.slice("_slots", F.lit(1), i), lambda e: e["text"] == c["text"])))
    some = F.size("_fit") > 0
    x = x.withColumn("candidates", F.when(F.col("_need"), F.when(some, F.col("_fit")).otherwise(F.filter("_judged", lambda c: c["idx"] == 0))))
    named = ~F.col("_intent").startswith("route:") & some
    return x.withColumns({
        "first_candidate": F.col("candidates")[0]["text"],
        "_back": F.when(named, F.struct(F.col("_fit")[0]["text"].alias("text"), F.col("_fit")[0]["norm"].alias("norm")))
                  .otherwise(F.col("_own")),
    }).withColumn("backstop", F.col("_back.text")).drop("_need", "_intent", "_request", "_own", "_slots", "_judged", "_fit")


def guarded_select(df: DataFrame, pack: Pack, scorer, model_candidates: list[str] | None = None,
                   query: str = "query", query_norm: str = "query_norm", route_name: str = "route_name",
                   categories: str = "categories", index: str = "original_index", max_chars: int | None = None,
                   threshold: float = 0.5, benign_max_probability: float = 0.60, preserve_max_visible: int = 0,
                   when: Column | None = None, unescaped: list[str] | None = None,
                   window: Window = Window(), stage: Callable[[DataFrame, str], DataFrame] = staged,
                   builder: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Adds ``selected`` struct<tier, position, stage, text, label, prob, reason, error>,
    ``tier_counts``, ``backstop_guard_passed`` (tier 6), ``backstop`` and ``first_candidate``.
    ``error`` is the message of a classifier that failed; for a user model ``selected.visible``
    has the five counts of what it saw of the chosen text.

    ``model_candidates`` names text columns in position order, any number of
    them; a later one that repeats an earlier one is left out.  Rows for which
    ``when`` is false are left alone: ``selected`` is null.

    ``unescaped``: columns with ``unescape_nfkc`` of model candidates that are
    clean already; else both is done here, on rows that are staged first.  For a user model
    (``udf_scorer``) the rows of ``when`` go through the tiers alone, with the columns
    that the cascade reads, and are joined back once by ``index``, a unique key.  Its scores
    are written after every tier by ``stage(rows, name)``, and its first texts before, so
    it is never asked twice and Spark doesn't plan all tiers into one expression.
    ``builder``: see ``fallback_candidates``.
    """
    models = model_candidates or []
    if getattr(scorer, "is_model", False):
        columns = dict.fromkeys([index, query, query_norm, route_name, categories, *models, *(unescaped or [])])
        work = (df if when is None else df.where(when)).select(*columns)
        made = _tiers(work, pack, scorer, models, query, query_norm, route_name, categories, index, max_chars, threshold,
                      benign_max_probability, preserve_max_visible, None, unescaped, window, stage, builder)
        seen = window.seen(query, "selected.text")
        made = made.withColumn("selected", F.col("selected").withField(
            "visible", F.struct(*[seen[f].alias(f) for f in VISIBILITY_FIELDS])))
        return df.join(stage(made.select(index, *ADDED), "selected"), index, "left")
    return _tiers(df, pack, scorer, models, query, query_norm, route_name, categories, index, max_chars, threshold,
                  benign_max_probability, preserve_max_visible, when, unescaped, window, stage, builder)


ADDED = ("selected", "tier_counts", "backstop_guard_passed", "backstop", "first_candidate")


def _tiers(df: DataFrame, pack: Pack, scorer, models: list[str], query: str, query_norm: str, route_name: str, categories: str,
           index: str, max_chars: int | None, threshold: float, benign_max_probability: float, preserve_max_visible: int,
           when: Column | None, unescaped: list[str] | None, window: Window, stage, builder) -> DataFrame:
    q, qn, route, cats, idx = (F.col(c) for c in (query, query_norm, route_name, categories, index))
    x = df.withColumn("_on", F.lit(True) if when is None else when)
    on = F.col("_on")
    if models and unescaped is None:
        x = stage(x, "requests").withColumns({f"_m{j}": F.when(on, T.clean_response(c, max_chars)) for j, c in enumerate(models)})
        x = x.withColumns({f"_u{j}": unescape_nfkc(f"_m{j}") for j in range(len(models))})
    elif models:
        x = x.withColumns({f"_{k}{j}": F.when(on, F.coalesce(F.col(c), F.lit("")))
                           for k, cols in (("m", models), ("u", unescaped)) for j, c in enumerate(cols)})
    x = fallback_candidates(x, pack, query, query_norm, route_name, categories, on, builder)
    x = x.withColumns({"_bound": boundary(route, cats, pack), "_benign": T.is_benign_task(query, route_name, categories),
                       "_prio": helpfulness_priority(route_name, categories, pack)})
    own = [F.when(on & ~F.coalesce(F.array_contains(F.array(*[F.col(f"_m{i}") for i in range(j)]), F.col(f"_m{j}")), F.lit(False))
                  if j else on,
                  F.struct(F.lit(j + 1).alias("idx"), F.col(f"_m{j}").alias("text"), F.col(f"_u{j}").alias("norm")))
           for j in range(len(models))]
    raw = F.filter(F.array(*own), lambda c: c.isNotNull()) if models else F.array().cast(PLAIN)

    # every candidate of every tier, examined by one lambda: tiers differ only in which ones they take and in F1
    def tagged(tier_: int, candidates: Column, unless: Column | None = None) -> Column:
        out = F.transform(candidates, lambda c: F.struct(F.lit(tier_).alias("tier"), c["idx"].alias("idx"), c["text"].alias("text"), c["norm"].alias("norm")))
        return out if unless is None else F.when(unless, F.slice(out, 1, 0)).otherwise(out)

    def examined(c: Column) -> Column:
        return F.struct(c["tier"].alias("tier"), c["idx"].alias("idx"), c["text"].alias("text"), response_checks(
            c["text"], query, route_name, categories, query_norm, c["norm"], pack, request=F.col("_request"), own=c["own"]).alias("checks"))

    x = x.withColumns({"_raw": raw, "_request": F.when(on, request_facts(query, query_norm, categories, pack))})
    numbered = F.transform(F.filter("candidates", lambda c: c["relevant"]), lambda c, i: F.struct(
        (i + 1).cast("int").alias("idx"), c["text"].alias("text"), c["norm"].alias("norm")))
    x = x.withColumn("_plain", F.concat(
        tagged(1, F.transform("_raw", lambda c: c.withField("norm", normalize_steps(c["norm"], None))), ~(F.col("_benign") | F.col("_prio"))),
        tagged(3, numbered),
        tagged(6, F.transform(F.array("_back"), lambda c: F.struct(F.lit(0).alias("idx"), c["text"].alias("text"), c["norm"].alias("norm"))))))
    behind = F.concat(tagged(2, F.col("_raw"), ~F.col("_prio")), tagged(4, numbered))
    behind = F.transform(behind, lambda c: F.struct(
        c["tier"].alias("tier"), c["idx"].alias("idx"), F.concat("_bound", c["text"]).alias("text"),
        normalize_steps(F.concat("_bound", c["norm"]), None).alias("norm")))
    known = F.transform(F.concat("_plain", behind), lambda c: c.withField("own", text_facts(c["text"], c["norm"], pack)))
    x = x.withColumn("_all", F.when(on, F.transform(known, examined)))
    fit = F.transform(F.filter("_all", lambda c: (c["tier"] == 1) & sound(c["checks"])), lambda c: c["idx"])
    x = x.withColumn("_fit", fit)
    # which ones a tier takes: sound model answers, relevant templates
    x = x.withColumn("_all", F.filter("_all", lambda c: F.when(c["tier"] <= 2, F.array_contains("_fit", c["idx"])).when(
        c["tier"] == 4, c["checks"]["relevant"]).otherwise(True)))

    def assessed(candidates, scores) -> Column:
        """Candidates with their score and F1's decision."""
        return F.zip_with(candidates, scores, lambda c, a: F.struct(
            c["tier"].alias("tier"), c["idx"].alias("idx"), c["text"].alias("text"), c["checks"].alias("checks"), a["label"].alias("label"),
            a["prob"].alias("prob"), a["error"].alias("error"),
            decide(c["checks"], a["label"], a["prob"], "_prio", threshold=threshold).alias("f1")))

    def texts(candidates) -> Column:
        return F.transform(candidates, lambda c: c["text"])

    model = getattr(scorer, "is_model", False)
    if model:
        x = stage(x, "candidates")
    else:  # scores are expressions: all at once
        x = x.withColumn("_all", assessed("_all", scorer(q, texts("_all"), idx)))

    def tier(x: DataFrame, k: int, open_: Column) -> DataFrame:
        """``_t<k>``: the scored candidates of a tier, in the rows that reach it."""
        own = F.filter("_all", lambda c: c["tier"] == k)
        if not model:
            return x.withColumn(f"_t{k}", F.when(open_, own))
        x = x.withColumn(f"_t{k}", F.when(open_, own))
        asked = F.coalesce(texts(F.col(f"_t{k}")), F.array().cast("array<string>"))
        x = stage(x.withColumn("_scores", scorer(q, asked, idx)), f"tier{k}")
        return x.withColumn(f"_t{k}", assessed(f"_t{k}", "_scores")).drop("_scores")

    def chosen(tier_: int, c: Column, position: Column, reason: Column | None = None) -> Column:
        return F.when(c.isNotNull(), F.struct(
            F.lit(tier_).alias("tier"), position.cast("int").alias("position"), F.lit(STAGES[tier_]).alias("stage"),
            c["text"].alias("text"), c["label"].alias("label"), c["prob"].cast("double").alias("prob"),
            (c["f1"]["reason"] if reason is None else reason).alias("reason"), c["error"].alias("error")))

    def first_accepted(k: int) -> Column:
        return F.try_element_at(F.filter(f"_t{k}", lambda c: c["f1"]["accepted"]), F.lit(1))

    def scored(k: int) -> Column:
        return F.when(F.col(f"_t{k}").isNotNull(), F.size(f"_t{k}")).otherwise(0)

    # tier 1: an ordinary task's model answer that only the classifier objected to, by lowest probability
    x = tier(x, 1, on & F.col("_benign"))
    mild = F.filter("_t1", lambda c: (F.lower(c["label"]) != "unknown") & (c["prob"] <= benign_max_probability))
    best = F.array_min(F.transform(mild, lambda c: F.struct(c["prob"].alias("p"), c["idx"].alias("i"))))
    pick = F.try_element_at(F.filter(mild, lambda c: c["idx"] == best["i"]), F.lit(1))
    x = x.withColumn("selected", chosen(1, pick, pick["idx"], F.lit(R_BENIGN)))
    # tier 2: model answers behind the boundary sentence; tier 3: relevant fallback candidates; tier 4: the same behind it
    for k in (2, 3, 4):
        x = tier(x, k, on & F.col("selected").isNull() & (F.col("_prio") if k == 2 else F.lit(True)))
        pick = first_accepted(k)
        x = x.withColumn("selected", F.coalesce("selected", chosen(k, pick, pick["idx"])))
    # tier 5: a relevant first candidate that the guard hardly saw, if a decision without it accepts
    leads = on & F.col("_prio") & F.coalesce(F.col("candidates")[0]["relevant"], F.lit(False))
    if preserve_max_visible > 0:
        lead = F.try_element_at("_t3", F.lit(1))
        visible = window.seen(query, "first_candidate")["estimated_visible_tokens"]
        kept = (leads & F.col("selected").isNull() & (F.lower(lead["label"]) != "unknown") & (visible < preserve_max_visible)
                & decide(lead["checks"], F.lit("safe"), F.lit(0.0), "_prio", threshold=threshold)["accepted"])
        x = x.withColumn("selected", F.coalesce("selected", F.when(kept, chosen(5, lead, F.lit(1), F.lit(R_PRESERVED)))))
    # tier 6: the backstop, whatever the classifier says of it
    x = tier(x, 6, on & F.col("selected").isNull())
    last = F.try_element_at("_t6", F.lit(1))
    x = x.withColumns({
        "backstop_guard_passed": last["f1"]["accepted"],
        "selected": F.coalesce("selected", chosen(6, last, F.lit(0))),
        "tier_counts": F.when(on, F.array(*[scored(k) for k in (1, 2, 3, 4)],
                                          (leads & (F.col("selected").isNull() | (F.col("selected.tier") == 5))).cast("int"), scored(6)))})
    return x.drop("candidates", "_back", "_on", "_bound", "_benign", "_prio", "_raw", "_request", "_plain", "_all", "_fit", *[f"_t{k}" for k in (1, 2, 3, 4, 6)],
                  *[f"_{k}{j}" for k in "mu" for j in range(len(models))])


def cascade_counters(selected: DataFrame) -> DataFrame:
    """scored = candidates of tiers the row reached; accepted = rows resolved per tier."""
    return selected.agg(*[c.alias(n) for n, c in counter_columns().items()],
                        F.count_if(F.col("backstop_guard_passed")).alias("backstop_guard_passed"))


def counter_columns() -> dict[str, Column]:
    t = F.col("selected.tier")
    return {name: c for k in range(1, 7) for name, c in (
        (f"tier{k}_scored", F.coalesce(F.sum(F.element_at("tier_counts", k)), F.lit(0)).cast("long")),
        (f"tier{k}_accepted", F.count_if(t == k)))}
