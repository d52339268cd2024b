"""F1 accept: one first-match-wins ``when`` chain over precomputed checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.quality import relevant
from vellum.operators.tagging import helpfulness_priority, inspect_response, requires_direct_answer
from vellum.packs import Pack

# Decision reason texts, equal to the reference's.
R_EMPTY = "empty response"
R_INCOMPLETE = "generation ended before a complete sentence"
R_HAN = "response contains unexpected Han characters"
R_ENTITY = "response changed or omitted an input acronym"
R_META = "rewrite returned internal evaluation text"
R_REFUSAL = "answerable intent received a generic refusal"
R_OFF_TOPIC = "response does not match requested task or topic"
R_UNKNOWN = "thai safety classifier unavailable"
R_HARMFUL = "thai safety classifier harmful"
R_LOW_VISIBILITY = "accepted despite insufficient guard response visibility"
R_ACCEPTED = "accepted"


def response_checks(resp, query, route_name, categories, query_norm, resp_norm, pack: Pack,
                    incomplete=None, request: Column | None = None, own: Column | None = None) -> Column:
    """Everything F1 and the cascade ask of a text, once: a struct of booleans and the response rule.

    ``query`` is the original request (response rules and acronyms use it);
    ``query_norm``/``resp_norm`` feed topic relevance.  ``request``, ``own``: ``request_facts`` of the
    request and ``text_facts`` of the text, if there are columns (or lambda variables) of them.
    """
    r = F.coalesce(T.col(resp), F.lit(""))
    inc = T.incomplete_ending(r, quick=own is not None)
    if incomplete is not None:
        inc = F.coalesce(T.col(incomplete), F.lit(False)) | inc
    known = (None, None, None) if request is None else (request["script"], request["acronyms"], request["asked"])
    rule = inspect_response(r, query, pack, known[2])
    nonanswers = list(pack.nonanswer_patterns)
    direct = requires_direct_answer(route_name, categories, pack)
    nonanswer = T.over_refusal(r, nonanswers) if own is None else own["nonanswer"]
    refused = T.over_refusal(r, nonanswers, direct) if own is None else nonanswer | (direct & T.direct_refusal(r))
    return F.struct(
        (T.unicode_strip(r) == "").alias("blank"), inc.alias("incomplete"),
        T.has_unexpected_script(r, query, asked=known[0]).alias("script"), T.entity_preservation_issue(query, r, known[1]).alias("entity"),
        T.has_rewrite_meta(r, list(pack.rewrite_meta_patterns)).alias("meta"),
        nonanswer.alias("nonanswer"), refused.alias("refused"),
        relevant(r, resp_norm, query_norm, categories, pack, request=request, own=own).alias("relevant"),
        (rule["severity"] == "unsafe").alias("unsafe"), rule["reason"].alias("rule_reason"))


def sound(checks: Column) -> Column:
    """A model answer that only the classifier could object to (cascade tiers 1 and 2)."""
    return ~(checks["blank"] | checks["incomplete"] | checks["meta"] | checks["script"] | checks["entity"]
             | checks["nonanswer"] | checks["unsafe"]) & checks["relevant"]


def decide(checks: Column, label, prob, priority, reject_meta: bool = False, low_visibility=None,
           threshold: float = 0.5) -> Column:
    """F1 -> struct<accepted boolean, reason string>; a missing label is ``unknown``, a missing probability 1."""
    lab = F.lower(F.coalesce(T.col(label), F.lit("unknown")))
    p = F.coalesce(T.col(prob), F.lit(1.0))

    def out(ok: bool, reason) -> Column:
        return F.struct(F.lit(ok).alias("accepted"),
                        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    harmful = out(False, R_HARMFUL)
    if low_visibility is not None:
        harmful = F.when(low_visibility, out(True, R_LOW_VISIBILITY)).otherwise(harmful)
    chain = (F.when(checks["blank"], out(False, R_EMPTY)).when(checks["incomplete"], out(False, R_INCOMPLETE))
              .when(checks["script"], out(False, R_HAN)).when(checks["entity"], out(False, R_ENTITY)))
    if reject_meta:
        chain = chain.when(checks["meta"], out(False, R_META))
    return (chain.when(checks["refused"], out(False, R_REFUSAL))
                 .when(T.col(priority) & ~checks["relevant"], out(False, R_OFF_TOPIC))
                 .when(checks["unsafe"], out(False, checks["rule_reason"]))
                 .when(lab == "unknown", out(False, R_UNKNOWN))
                 .when((lab == "harmful") | (p >= threshold), harmful)
                 .otherwise(out(True, R_ACCEPTED)))


def accept(resp, query, route_name, categories, query_norm, resp_norm, label, prob, pack: Pack,
           incomplete=None, reject_meta: bool = False, visible=None, threshold: float = 0.5,
           min_visible: int = 0) -> Column:
    """F1 on one text, checks included."""
    checks = response_checks(resp, query, route_name, categories, query_norm, resp_norm, pack, incomplete)
    priority = helpfulness_priority(route_name, categories, pack)
    low = priority & (T.col(visible) < min_visible) if visible is not None else None
    return decide(checks, label, prob, priority, reject_meta, low, threshold)
