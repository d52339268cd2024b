"""lint_templates: which templates of a pack real requests reach, and what keeps the others from being used.

Every template is held against the requests that would be offered it: those
whose intent and keywords choose its variant (F4).  Its text goes through the
checks that the cascade would make (C9, then F1 with a classifier that has no
objection), alone and behind its boundary sentence (F5).  A template is dead if
no request reaches it, or if every request that does rejects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.accept import decide, response_checks
from vellum.operators.cascade import boundary, intent, max_variant
from vellum.operators.normalize import normalize_steps, normalized_literal
from vellum.operators.tagging import helpfulness_priority
from vellum.packs import Pack

R_NOT_RELEVANT = "response does not match requested task or topic"
UNREACHED, ACCEPTED = "no request reaches it", "accepted"


def template_table(pack: Pack, spark) -> DataFrame:
    """``key``, ``variant`` (place among the variants of its key, from 1), ``position``, ``keywords``, ``text``."""
    rows, variants = [], {}
    for key, keywords, texts in pack.templates:
        variants[key] = variants.get(key, 0) + 1
        rows += [(key, variants[key], i + 1, list(keywords), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, variant int, position int, keywords array<string>, text string")


def offered(intent_col: Column, query_norm: Column, pack: Pack) -> Column:
    """The variant that a request is offered: struct<key, variant, texts>, null without one."""
    chain, seen = None, {}
    for key, keywords, texts in pack.templates:
        seen[key] = seen.get(key, 0) + 1
        hit = (intent_col == key) & (T.has_any(query_norm, list(keywords)) if keywords else F.lit(True))
        own = F.struct(F.lit(key).alias("key"), F.lit(seen[key]).alias("variant"), F.array(*[F.struct(
            F.lit(i + 1).alias("position"), F.lit(t).alias("text"), normalized_literal(t).alias("norm")) for i, t in enumerate(texts)]).alias("texts"))
        chain = F.when(hit, own) if chain is None else chain.when(hit, own)
    return F.lit(None) if chain is None else chain


def lint_templates(requests: DataFrame, pack: Pack, query: str = "query", query_norm: str = "query_norm",
                   route_name: str = "route_name", categories: str = "categories") -> DataFrame:
    """One row per template: ``key``, ``variant``, ``position``, ``n_requests``, ``n_relevant``, ``n_accepted``,
    ``n_accepted_composite``, ``finding``.

    ``requests`` are normalized and routed (``tag_and_route``).  ``n_requests``: rows that
    are offered the template; ``n_relevant``: of these, rows whose topic it meets (C9);
    ``n_accepted``: rows on which F1 accepts it if the classifier says safe;
    ``n_accepted_composite``: the same behind the boundary sentence.  ``finding`` is
    ``accepted`` if any row takes it, alone or behind the boundary; else the first failing
    check of most of its rows (ties: the smaller text), or that no request reaches it.
    Requests are read once; counts by template are added up before the only exchange.
    """
    if not max_variant(pack):
        raise ValueError("the pack has no templates")
    qn, route, cats = F.col(query_norm), F.col(route_name), F.col(categories)
    x = requests.select(F.col(query).alias("query"), qn.alias("qn"), route.alias("route"), cats.alias("cats"))
    x = x.withColumns({"intent": intent(F.col("route"), F.col("cats"), pack), "bound": boundary(F.col("route"), F.col("cats"), pack),
                       "prio": helpfulness_priority("route", "cats", pack)})
    x = x.withColumn("offer", offered(F.col("intent"), F.col("qn"), pack))
    def behind(t: Column) -> Column:
        return F.struct(t["position"].alias("position"), F.lit(True).alias("composite"), F.concat("bound", t["text"]).alias("text"),
                        normalize_steps(F.concat("bound", t["norm"]), None).alias("norm"))

    def checked(t: Column) -> Column:
        return F.struct(t["position"].alias("position"), t["composite"].alias("composite"), response_checks(
            t["text"], "query", "route", "cats", "qn", t["norm"], pack).alias("checks"))

    def judged(t: Column) -> Column:
        v, fit = decide(t["checks"], F.lit("safe"), F.lit(0.0), "prio"), t["checks"]["relevant"]
        return F.struct(t["position"].alias("position"), t["composite"].alias("composite"), fit.alias("relevant"),
                        (fit & v["accepted"]).alias("taken"),
                        F.when(~fit & v["accepted"], R_NOT_RELEVANT).otherwise(v["reason"]).alias("reason"))

    alone = F.transform("offer.texts", lambda t: F.struct(t["position"].alias("position"), F.lit(False).alias("composite"),
                                                          t["text"].alias("text"), t["norm"].alias("norm")))
    both = F.concat(alone, F.transform("offer.texts", behind))
    # an inner explode, and a join on keys that may be null, would filter by these expressions
    # first; Spark moves such a filter below the tagging, with a copy of all rules in it
    x = x.select(F.coalesce("offer.key", F.lit("")).alias("key"), F.coalesce("offer.variant", F.lit(0)).alias("variant"),
                 F.explode_outer(F.transform(F.transform(both, checked), judged)).alias("t"))
    x = x.select("key", "variant", F.coalesce("t.position", F.lit(0)).alias("position"), "t.composite", "t.relevant", "t.taken", "t.reason")
    alone = ~F.col("composite")
    by_reason = x.groupBy("key", "variant", "position", "reason").agg(
        F.count_if(alone).alias("n"), F.count_if(alone & F.col("relevant")).alias("relevant"),
        F.count_if(alone & F.col("taken")).alias("taken"), F.count_if(F.col("composite") & F.col("taken")).alias("behind"))
    found = by_reason.groupBy("key", "variant", "position").agg(
        F.sum("n").alias("n_requests"), F.sum("relevant").alias("n_relevant"), F.sum("taken").alias("n_accepted"),
        F.sum("behind").alias("n_accepted_composite"),
        F.min(F.when(F.col("n") > F.col("taken"), F.struct((-F.col("n")).alias("minus"), "reason")))["reason"].alias("reason"))
    names = template_table(pack, requests.sparkSession).select("key", "variant", "position")
    out = names.join(found, ["key", "variant", "position"], "left").fillna(
        0, ["n_requests", "n_relevant", "n_accepted", "n_accepted_composite"])
    return out.withColumn("finding", F.when(F.col("n_requests") == 0, UNREACHED).when(
        F.col("n_accepted") + F.col("n_accepted_composite") > 0, ACCEPTED).otherwise(F.col("reason"))).drop("reason")
