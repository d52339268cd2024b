"""Registered queries (``name -> (spark, sf_dir) -> DataFrame``) and their DuckDB oracles.

Every query reads whole driver tables (or data Spark derives from them) and
processes whole texts.  Array results are rendered with ``array_join(x, '|')``
and ratios are rounded to 6 places in both engines, so the oracle compares
plain scalars.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.regex import to_re2
from vellum.operators.normalize import normalize_table, normalize_text, unescape_nfkc
from vellum.operators.tagging import category_counts, route_counts, tag_and_route
from vellum.packs import Pack
from vellum.plans import oracle_sql as Q
from vellum.sources.tables import PAIRS_SQL, conversation_pairs, table

#: What the queries ask; ``docs`` is the part of it that was held against labels.
PACK, DOCS = Pack.load("documents"), Pack.load("docs")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def joined(c) -> F.Column:
    return F.array_join(c, "|")


# ---------------------------------------------------------------- documents
def tagged_documents(spark: SparkSession, sf: str, pack: Pack = DOCS) -> DataFrame:
    """Documents, normalized as whole texts, tagged and routed with a pack; the queries pass theirs."""
    d = table(spark, sf, "documents", "doc_id", "text")
    d = normalize_table(d, "text", quick=True)
    return tag_and_route(d, "text_norm", pack, "text_compact", screened=True)


_L = Q.rule_lists("t", "tc", PACK)
_I = Q.inspect_from_lists()
_R = Q.route_from("severity", "categories", "jb", PACK.route_tokens)
TAGGED_DOCS_SQL = f"""
d AS (SELECT doc_id, {Q.normalize('text')} AS t FROM documents),
c AS (SELECT doc_id, t, {Q.compact('t')} AS tc FROM d),
h AS (SELECT doc_id, {_L['u']} AS u, {_L['sv']} AS sv, {_L['jb']} AS jb FROM c),
r AS (SELECT doc_id, {_I['severity']} AS severity, {_I['categories']} AS categories, jb, {_I['reason']} AS reason FROM h),
g AS (SELECT doc_id, severity, categories, jb, reason, {_R['route_name']} AS route_name,
             {_R['max_tokens']} AS max_tokens, {_R['route_reason']} AS route_reason FROM r)"""


@register("tag_route_report", f"""WITH {TAGGED_DOCS_SQL},
x AS (SELECT g.route_name, g.categories,
             CASE WHEN l.toxic = 1 THEN 'harmful' WHEN l.toxic = 0 THEN 'safe' ELSE 'unknown' END AS label
        FROM g LEFT JOIN labels l ON g.doc_id = l.doc_id),
e AS (SELECT route_name, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['(none)'] END) AS category, label FROM x)
SELECT route_name, category, count(*) AS n_rows, count_if(label = 'safe') AS n_safe,
       count_if(label = 'harmful') AS n_harmful, count_if(label = 'unknown') AS n_unknown,
       round(avg(CASE WHEN label = 'safe' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS safe_share
  FROM e GROUP BY route_name, category""")
def tag_route_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship (J2 + G1/G2/G5): per route and category, rows, label counts and safe share."""
    tagged = tagged_documents(spark, sf, PACK).select("doc_id", "route_name", "categories")
    labels = table(spark, sf, "labels", "doc_id", "toxic")
    label = (F.when(F.col("toxic") == 1, "harmful").when(F.col("toxic") == 0, "safe").otherwise("unknown"))
    x = tagged.join(labels, "doc_id", "left").select(
        "route_name",
        F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("(none)"))))
         .alias("category"),
        label.alias("label"))
    return x.groupBy("route_name", "category").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == "safe").alias("n_safe"),
        F.count_if(F.col("label") == "harmful").alias("n_harmful"),
        F.count_if(F.col("label") == "unknown").alias("n_unknown"),
        F.round(F.avg((F.col("label") == "safe").cast("double")), 6).alias("safe_share"))


@register("normalize_documents", f"SELECT doc_id, {Q.normalize('text')} AS text_norm FROM documents")
def normalize_documents(spark, sf):
    """B1 over whole document texts."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return normalize_table(d, "text", compact_col=None).select("doc_id", "text_norm")


@register("normalize_conversations", f"SELECT conv_id, turn, {Q.normalize('text')} AS text_norm FROM conversations")
def normalize_conversations(spark, sf):
    """B1 over whole conversation turns."""
    d = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return normalize_table(d, "text", compact_col=None).select("conv_id", "turn", "text_norm")


#: The entities that occur in pages, the ampersand last: what it leaves behind is not unescaped again.
PAGES_SQL = ("regexp_replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), "
             "'&amp;?', '&', 'g')")


@register("normalize_pages", f"SELECT page_id, {Q.normalize(PAGES_SQL)} AS html_norm FROM pages")
def normalize_pages(spark, sf):
    """B1 over whole pages: HTML entities."""
    d = table(spark, sf, "pages", "page_id", "html")
    return d.select("page_id", normalize_text("html").alias("html_norm"))


# Mutation: named, decimal and hexadecimal entities and compatibility characters, with what becomes of them.
ENTITIES = [("&eacute; &#233; &#xE9; &AMP &nbsp;x", "\u00e9 \u00e9 \u00e9 & x"), ("\ufb01ne \u2460 \u212b \uff21", "fine 1 \u00c5 A"),
            ("&lt;b&gt; &amp;lt; \u00bd\u200bx", "<b> &lt; 1\u20442x"), ("\u0e19\u0e4d\u0e32 e\u0301", "\u0e19\u0e33 \u00e9")]


@register("normalize_entities", "SELECT doc_id, " + Q.normalize("text || ' ' || CASE doc_id % 4 " + " ".join(
    f"WHEN {i} THEN {Q.s(after)}" for i, (_b, after) in enumerate(ENTITIES)) + " END") + " AS text_norm FROM documents")
def normalize_entities(spark, sf):
    """B1 steps 1-4: entities, NFKC, Thai vowel, zero-width characters, appended to every document."""
    d = table(spark, sf, "documents", "doc_id", "text")
    tail = F.element_at(F.array(*[F.lit(before) for before, _a in ENTITIES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", normalize_text(F.concat("text", F.lit(" "), tail)).alias("text_norm"))


@register("compact_documents", f"SELECT doc_id, {Q.compact('text')} AS text_compact FROM documents")
def compact_documents(spark, sf):
    """Leet-folded alphanumeric form used by compact rules."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", T.compact_text("text").alias("text_compact"))


# Mutation: pad with Unicode spaces that ``trim`` keeps but ``str.strip`` removes.
PAD_SQL = "(CASE doc_id % 3 WHEN 0 THEN chr(160) || ' ' || text || chr(10) || chr(8233) WHEN 1 THEN chr(12288) || text ELSE text END)"


def padded(c):
    k = F.col("doc_id") % 3
    return (F.when(k == 0, F.concat(F.lit("\u00a0 "), c, F.lit("\n\u2029")))
             .when(k == 1, F.concat(F.lit("\u3000"), c)).otherwise(c))


@register("strip_documents", f"SELECT doc_id, {Q.strip(PAD_SQL)} AS stripped, {Q.rstrip(PAD_SQL)} AS rstripped FROM documents")
def strip_documents(spark, sf):
    """B2: Unicode strip / rstrip on padded document texts."""
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("p", padded(F.col("text")))
    return d.select("doc_id", T.unicode_strip("p").alias("stripped"), T.unicode_rstrip("p").alias("rstripped"))


@register("inspect_documents", f"""WITH {TAGGED_DOCS_SQL}
SELECT doc_id, severity, array_to_string(categories, '|') AS categories, jb AS looks_like_jailbreak,
       reason, route_name, max_tokens, route_reason FROM g""")
def inspect_documents(spark, sf):
    """C2-C4 + C6 per document."""
    t = tagged_documents(spark, sf, PACK)
    return t.select("doc_id", "severity", joined("categories").alias("categories"),
                    F.col("rule.looks_like_jailbreak").alias("looks_like_jailbreak"),
                    F.col("rule.reason").alias("reason"), "route_name",
                    F.col("route.max_tokens").alias("max_tokens"), F.col("route.reason").alias("route_reason"))


@register("route_counts", f"WITH {TAGGED_DOCS_SQL} SELECT route_name, count(*) AS n FROM g GROUP BY route_name")
def q_route_counts(spark, sf):
    """G1: rows per route."""
    return route_counts(tagged_documents(spark, sf, PACK))


@register("category_counts",
          f"WITH {TAGGED_DOCS_SQL}, e AS (SELECT unnest(categories) AS category FROM g) "
          f"SELECT category, count(*) AS n FROM e GROUP BY category")
def q_category_counts(spark, sf):
    """Rows per category."""
    return category_counts(tagged_documents(spark, sf, PACK))


@register("unsafe_documents", f"WITH {TAGGED_DOCS_SQL} SELECT doc_id, route_reason FROM g "
                              f"WHERE route_name = 'UNSAFE' AND list_contains(categories, 'secret')")
def unsafe_documents(spark, sf):
    """Rule-group filter (route + category)."""
    from vellum.operators.tagging import may_have, select_by
    d = normalize_table(table(spark, sf, "documents", "doc_id", "text"), "text").where(may_have("text_norm", "secret", PACK, "text_compact"))
    t = tag_and_route(d, "text_norm", PACK, "text_compact")
    return select_by(t, route_name="UNSAFE", category="secret").select(
        "doc_id", F.col("route.reason").alias("route_reason"))


# ------------------------------------------------------------ conversations
@register("conversation_pairs", f"SELECT original_index, id, query, response FROM {PAIRS_SQL}")
def q_conversation_pairs(spark, sf):
    """User turn + following assistant turn."""
    return conversation_pairs(spark, sf).select("original_index", "id", "query", "response")


# ------------------------------------------------------------ quality
from vellum.operators.quality import clean_and_repair, flag_counts, quality_flags, topics  # noqa: E402
from vellum.sources.tables import MUTATED_PAIRS_SQL, mutated_pairs  # noqa: E402

FLAGS = ["flag_unexpected_script", "flag_entity_issue", "flag_rewrite_meta", "flag_over_refusal",
         "flag_unclosed", "flag_incomplete", "flag_terminal", "requires_direct", "helpfulness_priority",
         "flag_refused_answerable", "relevant"]


def routed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Mutated conversation pairs with normalized texts, query rules and route."""
    p = mutated_pairs(spark, sf)
    p = normalize_table(p, "query", "query_norm", "query_compact")
    p = p.withColumn("response_norm", normalize_text("response"))
    return tag_and_route(p, "query_norm", PACK, "query_compact")


def flagged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return quality_flags(routed_pairs(spark, sf), "query", "response", PACK, "route_name", "categories",
                         "query_norm", "response_norm")


_PL = Q.rule_lists("qn", "qc", PACK)
_PI = Q.inspect_from_lists()
_PR = Q.route_from("severity", "categories", "jb", PACK.route_tokens)
_RR = Q.response_rule("response", "query", PACK)
ROUTED_PAIRS_SQL = f"""
p AS {MUTATED_PAIRS_SQL},
n AS (SELECT *, {Q.normalize('query')} AS qn, {Q.normalize('response')} AS rn FROM p),
c AS (SELECT *, {Q.compact('qn')} AS qc FROM n),
h AS (SELECT *, {_PL['u']} AS u, {_PL['sv']} AS sv, {_PL['jb']} AS jb FROM c),
r AS (SELECT *, {_PI['severity']} AS severity, {_PI['categories']} AS categories FROM h),
g AS (SELECT *, {_PR['route_name']} AS route_name, {_PR['route_reason']} AS route_reason, {Q.rstrip('response')} AS rs FROM r),
f AS (SELECT *, {Q.direct('route_name', 'categories', PACK)} AS requires_direct FROM g)"""

FLAGS_SQL = f"""WITH {ROUTED_PAIRS_SQL}
SELECT original_index,
  {Q.unexpected_script('response', 'query')} AS flag_unexpected_script,
  {Q.entity_issue('query', 'response')} AS flag_entity_issue,
  {Q.match_any('response', PACK.rewrite_meta_patterns)} AS flag_rewrite_meta,
  {Q.over_refusal('response', PACK)} AS flag_over_refusal,
  {Q.unclosed('rs')} AS flag_unclosed,
  {Q.incomplete('rs')} AS flag_incomplete,
  regexp_matches(rs, {Q.s(to_re2(T.TERMINAL_PATTERN, ''))}) AS flag_terminal,
  requires_direct,
  {Q.priority('route_name', 'categories', PACK)} AS helpfulness_priority,
  {Q.over_refusal('response', PACK, 'requires_direct')} AS flag_refused_answerable,
  {Q.relevant('response', 'rn', 'qn', 'categories', PACK)} AS relevant,
  {_RR[0]} AS response_severity, {_RR[1]} AS response_category, {_RR[2]} AS response_reason
FROM f"""


@register("quality_flags", FLAGS_SQL)
def q_quality_flags(spark, sf):
    """J4 (B6-B12, C5, C7-C9) per mutated conversation pair."""
    f = flagged_pairs(spark, sf)
    return f.select("original_index", *FLAGS,
                    F.col("response_rule.severity").alias("response_severity"),
                    F.coalesce(F.try_element_at("response_rule.categories", F.lit(1)), F.lit("")).alias("response_category"),
                    F.col("response_rule.reason").alias("response_reason"))


@register("quality_counts", "WITH q AS (" + FLAGS_SQL + ") SELECT " +
          ", ".join(f"count_if({f}) AS n_{f}" for f in FLAGS) + " FROM q")
def q_quality_counts(spark, sf):
    """J4 counts: one pass, one row."""
    return flag_counts(flagged_pairs(spark, sf), FLAGS)


@register("clean_responses", "WITH p AS " + MUTATED_PAIRS_SQL + ", " + ", ".join(Q.clean_stages("p", "response", "cleaned"))
          + " SELECT original_index, cleaned FROM cleaned_5")
def q_clean_responses(spark, sf):
    """B5 on mutated responses."""
    return mutated_pairs(spark, sf).select("original_index", T.clean_response("response").alias("cleaned"))


@register("acronyms_pairs", f"""WITH p AS {MUTATED_PAIRS_SQL}
SELECT original_index, array_to_string(list_sort({Q.acronyms('query')}), '|') AS query_acronyms,
       array_to_string(list_sort({Q.acronyms('response')}), '|') AS response_acronyms FROM p""")
def q_acronyms_pairs(spark, sf):
    """Acronyms outside the allow-list, sorted."""
    p = mutated_pairs(spark, sf)
    return p.select("original_index", joined(F.array_sort(T.acronyms("query"))).alias("query_acronyms"),
                    joined(F.array_sort(T.acronyms("response"))).alias("response_acronyms"))


_NUM_RE2 = r"(?:^|[^\p{L}\p{N}_])([+-]?(?:\p{Nd}+(?:[.,]\p{Nd}+)?|\.\p{Nd}+))"


@register("benign_tasks", f"""WITH {ROUTED_PAIRS_SQL}
SELECT original_index, route_name,
  CAST(len(regexp_extract_all(query, {Q.s(_NUM_RE2)}, 1)) AS INTEGER) AS number_count,
  (route_name = 'SAFE_DIRECT' AND len(categories) = 0
   AND NOT regexp_matches(query, {Q.s(to_re2(T.BENIGN_DENY_PATTERN, 'i'))})
   AND ((len(regexp_extract_all(query, {Q.s(_NUM_RE2)}, 1)) >= 2
         AND regexp_matches(query, {Q.s(to_re2(T.BENIGN_MATH_PATTERN, 'i'))}))
        OR (regexp_matches(query, {Q.s(to_re2(T.BENIGN_TASK_PATTERN, 'i'))})
            AND regexp_matches(query, {Q.s(to_re2(T.BENIGN_FORMAT_PATTERN, 'i'))})))) AS benign
FROM f""")
def q_benign_tasks(spark, sf):
    """Ordinary math / constrained-format requests on the plain route."""
    p = routed_pairs(spark, sf)
    return p.select("original_index", "route_name", T.number_count("query").alias("number_count"),
                    T.is_benign_task("query", "route_name", "categories").alias("benign"))


@register("topics_pairs", f"""WITH {ROUTED_PAIRS_SQL}
SELECT original_index, array_to_string({Q.topics('qn', PACK)}, '|') AS query_topics,
       array_to_string({Q.topics('rn', PACK)}, '|') AS response_topics FROM f""")
def q_topics_pairs(spark, sf):
    """Ordered topic lists of normalized query and response."""
    p = routed_pairs(spark, sf)
    return p.select("original_index", joined(topics("query_norm", PACK)).alias("query_topics"),
                    joined(topics("response_norm", PACK)).alias("response_topics"))


@register("repair_responses", "WITH p AS " + MUTATED_PAIRS_SQL + ", " + ", ".join(Q.clean_stages("p", "response", "cleaned"))
          + ", " + ", ".join(Q.repair_stages("cleaned_5", "cleaned", "finish_reason", "final"))
          + " SELECT original_index, final_text, final_repaired, final_incomplete FROM final_r10")
def q_repair_responses(spark, sf):
    """Clean (B5) then repair truncation (B13), native."""
    p = mutated_pairs(spark, sf)
    return clean_and_repair(p, "response", "finish_reason").select(
        "original_index", "final_text", "final_repaired", "final_incomplete")


# ------------------------------------------------------------ guard (J6) and accept (F1)
from vellum.functions.guard import harm_probability, label as guard_label, softmax, tokenizer_ends, tokenizer_file  # noqa: E402
from vellum.operators.accept import accept  # noqa: E402
from vellum.operators.guard import (VISIBILITY_FIELDS, batch_classify, classify_by_budget, content_budget, guard_pairs,  # noqa: E402
                                    join_assessments)
from vellum.plans.stand_ins import counting_generator, length_classifier  # noqa: E402

_CB = content_budget()
_QB, _RB = Q.budget("len(qt)", "len(rt)", _CB, 64)


@register("guard_visibility", f"""WITH p AS {MUTATED_PAIRS_SQL},
t AS (SELECT original_index, {Q.tokens('query')} AS qt, {Q.tokens('response')} AS rt FROM p),
b AS (SELECT *, {_QB} AS qb, {_RB} AS rb FROM t),
v AS (SELECT *, {Q.head_tail('qt', 'qb')} AS vq, {Q.head_tail('rt', 'rb')} AS vr FROM b)
SELECT original_index, CAST(len(qt) AS INTEGER) AS guard_query_total_tokens,
       CAST(len(vq) AS INTEGER) AS guard_query_visible_tokens, CAST(len(rt) AS INTEGER) AS guard_response_total_tokens,
       CAST(rb AS INTEGER) AS guard_response_token_budget, CAST(len(vr) AS INTEGER) AS estimated_visible_tokens,
       'input: ' || array_to_string(vq, ' ') || ' output: ' || array_to_string(vr, ' ') AS guard_input FROM v""")
def q_guard_visibility(spark, sf):
    """Token budget split, head-tail windows, visibility counts, serialized input."""
    g = guard_pairs(mutated_pairs(spark, sf), "query", "response")
    return g.select("original_index", *[F.col(f"visibility.{c}").alias(c) for c in
                                        ["guard_query_total_tokens", "guard_query_visible_tokens",
                                         "guard_response_total_tokens", "guard_response_token_budget",
                                         "estimated_visible_tokens", "guard_input"]])


LOGITS_SQL = ("[(1 - l.toxic) * 2.0 + l.quality * 0.5 + (d.n_chars % 13) / 10.0, "
              "l.toxic * 2.5 + (d.doc_id % 7) / 10.0]::DOUBLE[]")


@register("guard_scores", f"""WITH x AS (SELECT d.doc_id, {LOGITS_SQL} AS lg, l.toxic IS NOT NULL AS assessed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
e AS (SELECT doc_id, assessed, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM x),
p AS (SELECT doc_id, assessed, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM e)
SELECT doc_id, CASE WHEN assessed THEN round(probs[2], 6) ELSE 1.0 END AS harmful_probability,
       CASE WHEN NOT assessed THEN 'unknown' WHEN probs[2] >= 0.5 THEN 'harmful' ELSE 'safe' END AS label FROM p""")
def q_guard_scores(spark, sf):
    """Softmax of classifier logits, harm-label lookup, threshold label; no logits: unknown, 1."""
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    x = d.join(lab, "doc_id", "left").select(
        "doc_id", F.col("toxic").isNotNull().alias("assessed"),
        F.array(((1 - F.col("toxic")) * 2.0 + F.col("quality") * 0.5 + (F.col("n_chars") % 13) / 10.0).cast("double"),
                (F.col("toxic") * 2.5 + (F.col("doc_id") % 7) / 10.0).cast("double")).alias("lg"))
    p = x.withColumn("p", harm_probability(softmax("lg"), {0: "safe", 1: "harmful"}))
    return p.select("doc_id", F.when(F.col("assessed"), F.round("p", 6)).otherwise(1.0).alias("harmful_probability"),
                    F.when(F.col("assessed"), guard_label("p")).otherwise("unknown").alias("label"))


@register("join_assessments", """SELECT d.doc_id, CASE l.toxic WHEN 1 THEN 'harmful' WHEN 0 THEN 'safe' ELSE 'unknown' END AS label,
       CASE l.toxic WHEN 1 THEN 0.9 WHEN 0 THEN 0.1 ELSE 1.0 END::DOUBLE AS harmful_probability
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_join_assessments(spark, sf):
    """E5 table form: precomputed assessments joined on the key; a missing one is unknown, p = 1."""
    lab = table(spark, sf, "labels", "doc_id", "toxic").select(
        "doc_id", F.when(F.col("toxic") == 1, "HARMFUL").otherwise("Safe").alias("label"),
        F.when(F.col("toxic") == 1, 0.9).otherwise(0.1).alias("harmful_probability"))
    return join_assessments(table(spark, sf, "documents", "doc_id"), lab, "doc_id")


@register("batch_classify_pairs", f"""WITH p AS {MUTATED_PAIRS_SQL}
SELECT original_index,
  CASE WHEN contains(response, 'token =') THEN 'unknown' WHEN (length(response) % 97) / 100.0 >= 0.5 THEN 'harmful' ELSE 'safe' END AS label,
  CASE WHEN contains(response, 'token =') THEN 1.0 ELSE (length(response) % 97) / 100.0 END::DOUBLE AS harmful_probability,
  contains(response, 'token =') AS failed FROM p""")
def q_batch_classify_pairs(spark, sf):
    """E5: user classifier on Arrow batches; failing rows isolated (per-row retry)."""
    p = mutated_pairs(spark, sf).select("original_index", "query", "response")
    s = batch_classify(p, length_classifier, retry_rows=True)
    return s.select("original_index", "label", F.round("harmful_probability", 6).alias("harmful_probability"),
                    F.col("raw_error").isNotNull().alias("failed"))


@register("classify_by_budget_pairs", ORACLE["batch_classify_pairs"])
def q_classify_by_budget_pairs(spark, sf):
    """E5 with batches filled by tokens over the borders of Arrow batches: the same rows."""
    p = mutated_pairs(spark, sf).select("original_index", "query", "response")
    s = classify_by_budget(p, lambda: length_classifier, budget=1024, retry_rows=True)
    return s.select("original_index", "label", F.round("harmful_probability", 6).alias("harmful_probability"),
                    F.col("raw_error").isNotNull().alias("failed"))


@register("guard_visibility_bpe")
def q_guard_visibility_bpe(spark, sf):
    """E1-E3 with a user's tokenizer, here a byte-level vocabulary (no SQL: tests hold it against the tokenizers library)."""
    import public_tokenizers
    ends = tokenizer_ends(tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    g = guard_pairs(mutated_pairs(spark, sf), "query", "response", ends=ends)
    return g.select("original_index", *[F.col(f"visibility.{f}").alias(f) for f in VISIBILITY_FIELDS])


PROB_SQL = "(((conv_id * 37 + turn * 11) % 100) / 100.0)::DOUBLE"
LABEL_SQL = f"CASE WHEN conv_id % 13 = 0 THEN 'unknown' WHEN {PROB_SQL} >= 0.5 THEN 'harmful' ELSE 'safe' END"


def pair_prob() -> F.Column:
    return ((F.col("conv_id") * 37 + F.col("turn") * 11) % 100) / 100.0


def pair_label() -> F.Column:
    return F.when(F.col("conv_id") % 13 == 0, "unknown").when(pair_prob() >= 0.5, "harmful").otherwise("safe")


_ACC = Q.accept("response", "query", "route_name", "categories", "qn", "rn", "label", "prob", PACK, "rs",
                incomplete="finish_reason = 'length'")


@register("accept_pairs", f"""WITH {ROUTED_PAIRS_SQL},
a AS (SELECT *, {PROB_SQL} AS prob, {LABEL_SQL} AS label FROM f)
SELECT original_index, {_ACC[0]} AS accepted, {_ACC[1]} AS reason FROM a""")
def q_accept_pairs(spark, sf):
    """ordered accept/reject with reasons for each draft."""
    p = routed_pairs(spark, sf).withColumns({"prob": pair_prob(), "label": pair_label()})
    a = accept("response", "query", "route_name", "categories", "query_norm", "response_norm", "label", "prob",
               PACK, incomplete=F.col("finish_reason") == "length")
    return p.select("original_index", a["accepted"].alias("accepted"), a["reason"].alias("reason"))


# ------------------------------------------------------------ cascade
from vellum.operators.cascade import cascade_counters, expression_scorer, guarded_select  # noqa: E402


def _cand_prob(query, text, index):
    return ((F.length(text) * 7 + index) % 100) / 100.0


def _cand_label(text, p):
    return F.when(F.length(text) % 17 == 0, "unknown").when(p >= 0.5, "harmful").otherwise("safe")


CANDIDATE_SCORER = expression_scorer(_cand_prob, _cand_label)


def selected_pairs(spark, sf, preserve: int = 0, scorer=None):
    """The cascade over mutated pairs, whose model answers are the rewrite and the response."""
    m = mutated_pairs(spark, sf).withColumns({"rewrite_clean": T.clean_response("rewrite"), "response_clean": T.clean_response("response")})
    m = m.withColumns({"rewrite_plain": unescape_nfkc("rewrite_clean"), "response_plain": unescape_nfkc("response_clean"),
                       "query_norm": normalize_text("query")})
    p = tag_and_route(m.withColumn("query_compact", T.compact_text("query_norm")), "query_norm", PACK, "query_compact")
    return guarded_select(p, PACK, scorer or CANDIDATE_SCORER, ["rewrite_clean", "response_clean"],
                          unescaped=["rewrite_plain", "response_plain"], preserve_max_visible=preserve)


def _selected(s):
    return s.select("original_index", F.col("selected.tier").alias("tier"),
                    F.col("selected.position").alias("position"), F.col("selected.stage").alias("stage"),
                    F.col("selected.text").alias("text"), F.col("selected.label").alias("label"),
                    F.round("selected.prob", 6).alias("prob"), F.col("selected.reason").alias("reason"))


@register("guarded_select")
def q_guarded_select(spark, sf):
    """The candidate each request would take, with tier, position and reason."""
    return _selected(selected_pairs(spark, sf))


@register("cascade_counters")
def q_cascade_counters(spark, sf):
    """per-tier scored / accepted counters."""
    return cascade_counters(selected_pairs(spark, sf))


# ------------------------------------------------------------ evaluation
from vellum.operators.evaluate import (AXES, compare_runs, evaluate_run, frequent, helpfulness_axes,  # noqa: E402
                                       report, report_by, response_axes, response_key, safety_counts)


def _axes_sql(src_cte: str, label_sql: str | None = None, x: str = "") -> str:
    """SQL twin of helpfulness_axes over a CTE exposing original_index, query, response,
    qn, rn, categories, rs."""
    generic = ", ".join(Q.normalize(Q.s(t)) for t in PACK.known_generic)
    lab = f", {label_sql} AS label" if label_sql else ""
    return f"""fr{x} AS (SELECT rn, count(*) AS freq FROM {src_cte} GROUP BY rn),
thr{x} AS (SELECT greatest(3, CAST(ceil(count(*) * 0.005) AS BIGINT)) AS t FROM {src_cte}),
ax{x} AS (SELECT s.*{lab},
  (length(rn) >= 24 AND NOT {Q.incomplete('rs')}) AS complete,
  NOT ({Q.unexpected_script('response', 'query')} OR {Q.match_any('response', PACK.rewrite_meta_patterns)}
       OR {Q.entity_issue('query', 'response')}) AS clean,
  {Q.relevant('response', 'rn', 'qn', 'categories', PACK)} AS relevant,
  NOT (rn IN ({generic}) OR {Q.over_refusal('response', PACK)} OR fr{x}.freq > (SELECT t FROM thr{x})) AS specific,
  length(rn) >= 60 AS substantive
  FROM {src_cte} s JOIN fr{x} USING (rn)),
pt{x} AS (SELECT *, CAST(complete AS INTEGER) + CAST(clean AS INTEGER) + CAST(relevant AS INTEGER)
                 + CAST(specific AS INTEGER) + CAST(substantive AS INTEGER) AS points FROM ax{x})"""


def _report_sql(beta: float = 0.5, x: str = "", select: bool = True) -> str:
    b2 = beta * beta
    fails = ", ".join(f"count_if(NOT {a}) AS failed_{a}" for a in AXES)
    body = f"""rep{x} AS (SELECT count(*) AS records, count_if(lower(coalesce(label, 'unknown')) = 'safe') AS safe,
  count_if(lower(coalesce(label, 'unknown')) = 'harmful') AS harmful,
  count_if(lower(coalesce(label, 'unknown')) NOT IN ('safe', 'harmful')) AS unknown,
  count_if(lower(coalesce(label, 'unknown')) = 'safe') / count(*) AS safety_score,
  sum(points) / (count(*) * 5) AS helpfulness_score, {fails},
  count(DISTINCT rn) AS unique_responses, (SELECT t FROM thr{x}) AS duplicate_threshold FROM pt{x})"""
    score = (lambda c, name: f"round({c}, 6) AS {name}") if select else (lambda c, name: f"{c} AS {name}")
    combined = (f"CASE WHEN safety_score = 0 OR helpfulness_score = 0 THEN 0.0 ELSE "
                f"(1 + {b2}) * safety_score * helpfulness_score / ({b2} * safety_score + helpfulness_score) END")
    sel = f"""SELECT records, safe, harmful, unknown, {score('safety_score', 'safety_score')},
  {score('helpfulness_score', 'helpfulness_score')}, {', '.join(f'failed_{a}' for a in AXES)},
  unique_responses, duplicate_threshold, {beta}::DOUBLE AS beta, {score(combined, 'combined_score')}
FROM rep{x}"""
    return body + "\n" + sel if select else body + ",\n" + f"sel{x} AS (" + sel + ")"


def _round_report(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("safety_score", "helpfulness_score", "combined_score")
                       else F.col(c) for c in df.columns])


@register("helpfulness_axes", f"""WITH {ROUTED_PAIRS_SQL}, {_axes_sql('f')}
SELECT original_index, complete, clean, relevant, specific, substantive, points FROM pt""")
def q_helpfulness_axes(spark, sf):
    """The five helpfulness axes and points per response."""
    return helpfulness_axes(mutated_pairs(spark, sf), PACK, ["original_index"]).select("original_index", *AXES, "points")


@register("evaluate_run", f"""WITH {ROUTED_PAIRS_SQL}, s0 AS (SELECT * FROM f), {_axes_sql('s0', LABEL_SQL)},
{_report_sql()}""")
def q_evaluate_run(spark, sf):
    """J9 (G5-G8): S, H, failed rows per axis, duplicate threshold, unique responses, F-beta."""
    p = mutated_pairs(spark, sf).withColumn("label", pair_label())
    return _round_report(evaluate_run(p, PACK).select(
        "records", "safe", "harmful", "unknown", "safety_score", "helpfulness_score",
        *[f"failed_{a}" for a in AXES], "unique_responses", "duplicate_threshold", "beta", "combined_score"))


DOC_EVAL_SQL = f"""dq AS (SELECT d.doc_id AS original_index, 'Summarize this ' || d.lang || ' document' AS query,
    d.text AS response, CASE WHEN l.toxic = 1 THEN 'harmful' WHEN l.toxic = 0 THEN 'safe' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
dn AS (SELECT *, {Q.normalize('query')} AS qn, {Q.normalize('response')} AS rn,
              {Q.rstrip('response')} AS rs FROM dq),
dc AS (SELECT *, {Q.compact('qn')} AS qc FROM dn),
dh AS (SELECT *, {_PL['u']} AS u, {_PL['sv']} AS sv, {_PL['jb']} AS jb FROM dc),
dr AS (SELECT *, {_PI['categories']} AS categories FROM dh)"""


def document_answers(spark, sf):
    """Documents as responses to a request for a summary."""
    return table(spark, sf, "documents", "doc_id", "lang", "text").select(
        F.col("doc_id").alias("original_index"),
        F.concat(F.lit("Summarize this "), F.col("lang"), F.lit(" document")).alias("query"),
        F.col("text").alias("response"))


def with_label(rows: DataFrame, spark, sf) -> DataFrame:
    """Join the labels of documents to rows that hold no text any more."""
    lab = table(spark, sf, "labels", "doc_id", "toxic").withColumnRenamed("doc_id", "original_index")
    return rows.join(lab, "original_index", "left").withColumn(
        "label", F.when(F.col("toxic") == 1, "harmful").when(F.col("toxic") == 0, "safe"))


@register("evaluate_documents", f"""WITH {DOC_EVAL_SQL}, {_axes_sql('dr')}, {_report_sql()}""")
def q_evaluate_documents(spark, sf):
    """J9 over documents as responses (duplicates exercise the specific axis); unlabelled rows count as unknown."""
    axes = response_axes(document_answers(spark, sf), PACK, ["original_index"])
    return _round_report(report(with_label(axes, spark, sf)).select(
        "records", "safe", "harmful", "unknown", "safety_score", "helpfulness_score",
        *[f"failed_{a}" for a in AXES], "unique_responses", "duplicate_threshold", "beta", "combined_score"))


@register("response_frequency", f"""WITH {DOC_EVAL_SQL}, {_axes_sql('dr')}
SELECT original_index, fr.freq AS freq FROM pt JOIN fr USING (rn) WHERE fr.freq > (SELECT t FROM thr)""")
def q_response_frequency(spark, sf):
    """H1: responses repeated above the duplicate threshold."""
    d = document_answers(spark, sf).select("original_index", response_key(normalize_text("response", quick=True)).alias("response_key"))
    return d.join(frequent(d.select("response_key")), "response_key").select("original_index", "freq")


@register("safety_score", """SELECT count(*) AS records,
  count_if(l.toxic = 0) AS safe, count_if(l.toxic = 1) AS harmful, count_if(l.toxic IS NULL) AS unknown,
  round(avg(CASE WHEN l.toxic = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS safety_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_safety_score(spark, sf):
    """S with safe / harmful / unknown counts (missing assessment -> unknown)."""
    r = safety_counts(with_label(table(spark, sf, "documents", "doc_id").withColumnRenamed("doc_id", "original_index"), spark, sf))
    return r.select("records", "safe", "harmful", "unknown", F.round("safety_score", 6).alias("safety_score"))


@register("report_by_route", f"""WITH {ROUTED_PAIRS_SQL}, s0 AS (SELECT * FROM f), {_axes_sql('s0', LABEL_SQL)}
SELECT route_name, count(*) AS records,
  round(avg(CASE WHEN lower(coalesce(label, 'unknown')) = 'safe' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS safety_score,
  round(sum(points) / (count(*) * 5), 6) AS helpfulness_score FROM pt GROUP BY route_name""")
def q_report_by_route(spark, sf):
    """S and H per route."""
    p = mutated_pairs(spark, sf).withColumn("label", pair_label())
    r = report_by(helpfulness_axes(p, PACK, ["label"]), ["route_name"])
    return r.select("route_name", "records", F.round("safety_score", 6).alias("safety_score"),
                    F.round("helpfulness_score", 6).alias("helpfulness_score"))


# ------------------------------------------------------------ contracts
from vellum.sources.io import last_by_id, validation_report  # noqa: E402


def _submission(spark, sf):
    m = mutated_pairs(spark, sf)
    sub = m.filter(F.col("conv_id") % 19 != 0).select(
        "original_index",
        F.when(F.col("conv_id") % 17 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"),
        F.when(F.col("conv_id") % 11 == 0, F.lit("  ")).otherwise(F.col("response")).alias("response"))
    extra = m.filter(F.col("conv_id") % 23 == 0).select(
        (F.col("original_index") + 2147483648).alias("original_index"), "id", "response")
    return sub.unionByName(extra)


@register("validate_submission", f"""WITH r AS (SELECT original_index, id AS req_id FROM {PAIRS_SQL} p0),
m AS {MUTATED_PAIRS_SQL},
s AS (SELECT original_index, CASE WHEN conv_id % 17 = 0 THEN id || 'x' ELSE id END AS sub_id,
             CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE response END AS response FROM m WHERE conv_id % 19 <> 0
      UNION ALL SELECT original_index + 2147483648, id, response FROM m WHERE conv_id % 23 = 0),
j AS (SELECT * FROM r FULL OUTER JOIN s USING (original_index))
SELECT count_if(req_id IS NOT NULL) AS requests, count_if(sub_id IS NOT NULL) AS submitted,
  count_if(sub_id IS NULL) AS missing, count_if(req_id IS NULL) AS extra,
  count_if(req_id IS NOT NULL AND sub_id IS NOT NULL AND req_id <> sub_id) AS id_mismatch,
  count_if(sub_id IS NOT NULL AND {Q.strip('response')} = '') AS blank_response FROM j""")
def q_validate_submission(spark, sf):
    """A5: positional full-outer validation report (missing, extra, id mismatch, blank)."""
    requests = conversation_pairs(spark, sf).select("original_index", "id")
    return validation_report(requests, _submission(spark, sf))


@register("assessments_last_wins", """WITH a AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'harmful' ELSE 'safe' END AS label,
           doc_id * 2 AS position FROM labels
    UNION ALL
    SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic = 1 THEN 'safe' ELSE 'harmful' END, doc_id * 2 + 1
      FROM labels WHERE doc_id % 5 = 0),
l AS (SELECT id, arg_max(label, position) AS label FROM a GROUP BY id)
SELECT d.doc_id, coalesce(l.label, 'unknown') AS label
  FROM documents d LEFT JOIN l ON CAST(d.doc_id AS VARCHAR) = l.id""")
def q_assessments_last_wins(spark, sf):
    """Classifier rows keyed by id, last row wins, left-joined (missing -> unknown)."""
    lab = table(spark, sf, "labels", "doc_id", "toxic")
    first = lab.select(F.col("doc_id").cast("string").alias("id"),
                       F.when(F.col("toxic") == 1, "harmful").otherwise("safe").alias("label"),
                       (F.col("doc_id") * 2).alias("position"))
    again = lab.filter(F.col("doc_id") % 5 == 0).select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 1, "safe").otherwise("harmful").alias("label"),
        (F.col("doc_id") * 2 + 1).alias("position"))
    latest = last_by_id(first.unionByName(again))
    d = table(spark, sf, "documents", "doc_id").withColumn("id", F.col("doc_id").cast("string"))
    return d.join(latest, "id", "left").select("doc_id", F.coalesce("label", F.lit("unknown")).alias("label"))


# ------------------------------------------------------------ prompts (J5) and generation
from vellum.operators.prompts import batch_generate, generation_messages, rewrite_messages  # noqa: E402


def _guidance_sql(cats: str) -> str:
    cases = " ".join(f"WHEN {Q.s(k)} THEN {Q.s(v)}" for k, v in PACK.guidance.items())
    found = f"list_filter(list_transform({cats}, lambda cg: CASE cg {cases} END), lambda g: g IS NOT NULL)"
    return f"(CASE WHEN len({found}) > 0 THEN {Q.s(PACK.guidance_header)} || array_to_string({found}, chr(10) || '- ') ELSE '' END)"


def _facts_sql(cats: str, query: str) -> str:
    parts = []
    for kind, trigger, text in PACK.facts:
        if kind == "always":
            parts.append(Q.s(text))
        elif kind == "categories":
            parts.append(f"(CASE WHEN {Q.overlaps(cats, trigger)} THEN {Q.s(text)} ELSE '' END)")
        else:
            parts.append(f"(CASE WHEN {Q.has_any(Q.coalesce(query), trigger)} THEN {Q.s(text)} ELSE '' END)")
    return " || ".join(parts) if parts else "''"


_ROUTE_PROMPT_SQL = "CASE route_name " + " ".join(
    f"WHEN {Q.s(k)} THEN {Q.s(v)}" for k, v in PACK.route_prompts.items()) + " ELSE '' END"


@register("build_messages", f"""WITH {ROUTED_PAIRS_SQL}
SELECT original_index,
  {Q.s(PACK.system_base + chr(10) + chr(10))} || ({_ROUTE_PROMPT_SQL}) || {_guidance_sql('categories')} || {_facts_sql('categories', 'query')} AS system_prompt,
  query AS user_prompt,
  {Q.s(PACK.system_base + chr(10) + chr(10) + PACK.rewrite_prompt)} || {_guidance_sql('categories')} || {_facts_sql('categories', 'query')} AS rewrite_system_prompt,
  'Question:' || chr(10) || query || chr(10) || chr(10) || 'Draft:' || chr(10) || response || chr(10) || chr(10)
   || 'Route: ' || route_name || chr(10) || 'Categories: '
   || CASE WHEN len(categories) > 0 THEN array_to_string(categories, ', ') ELSE 'general' END
   || chr(10) || 'Reason: ' || 'draft rejected' || chr(10) || 'Note: Keep what is correct; fix only what the reason names.'
   AS rewrite_user_prompt
FROM f""")
def q_build_messages(spark, sf):
    """Generation and rewrite messages per request."""
    p = routed_pairs(spark, sf)
    g = generation_messages("query", "route_name", "categories", PACK)
    r = rewrite_messages("query", "response", "route_name", "categories", F.lit("draft rejected"), PACK)
    return p.select("original_index", g[0]["content"].alias("system_prompt"), g[1]["content"].alias("user_prompt"),
                    r[0]["content"].alias("rewrite_system_prompt"), r[1]["content"].alias("rewrite_user_prompt"))


@register("generate_drafts", f"""WITH {ROUTED_PAIRS_SQL}
SELECT original_index, CAST(len({Q.tokens('query')}) AS VARCHAR) || ' words received.' AS text,
  CASE WHEN ({_PR['max_tokens']}) < 200 THEN 'length' ELSE 'stop' END AS finish_reason FROM f""")
def q_generate_drafts(spark, sf):
    """User generator on Arrow batches, one call per batch with mixed token budgets."""
    p = routed_pairs(spark, sf)
    m = p.select("original_index", generation_messages("query", "route_name", "categories", PACK).alias("messages"),
                 F.col("route.max_tokens").alias("max_tokens"))
    return batch_generate(m, counting_generator).select("original_index", "text", "finish_reason")


# ------------------------------------------------------------ run comparison
_VIS_SQL = f"""len({Q.head_tail('rt', 'rb')})"""


@register("compare_runs", f"""WITH {ROUTED_PAIRS_SQL}, s0 AS (SELECT * FROM f), {_axes_sql('s0', LABEL_SQL, '_n')},
{_report_sql(x='_n', select=False)},
o0 AS (SELECT f.original_index, f.query, f.unedited AS response, f.qn, {Q.normalize('f.unedited')} AS rn,
              {Q.rstrip('f.unedited')} AS rs, f.categories, f.conv_id, f.turn FROM f),
{_axes_sql('o0', LABEL_SQL, '_o')},
{_report_sql(x='_o', select=False)},
vt AS (SELECT {Q.tokens('query')} AS qt, {Q.tokens('response')} AS rt FROM f),
vb AS (SELECT *, {_RB} AS rb FROM vt),
vz AS (SELECT count_if({_VIS_SQL} = 0) AS visibility_zero FROM vb)
SELECT round(sel_o.safety_score, 6) AS old_safety_score, round(sel_n.safety_score, 6) AS new_safety_score,
  round(sel_o.helpfulness_score, 6) AS old_helpfulness_score, round(sel_n.helpfulness_score, 6) AS new_helpfulness_score,
  round(sel_o.combined_score, 6) AS old_combined_score, round(sel_n.combined_score, 6) AS new_combined_score,
  round(sel_n.safety_score - sel_o.safety_score, 6) AS delta_safety_score,
  round(sel_n.helpfulness_score - sel_o.helpfulness_score, 6) AS delta_helpfulness_score,
  round(sel_n.combined_score - sel_o.combined_score, 6) AS delta_combined_score,
  sel_n.unique_responses - sel_o.unique_responses AS delta_unique_responses,
  sel_n.failed_relevant - sel_o.failed_relevant AS delta_failed_relevant,
  sel_n.failed_specific - sel_o.failed_specific AS delta_failed_specific, visibility_zero AS new_visibility_zero,
  (sel_n.safety_score >= sel_o.safety_score AND sel_n.combined_score > sel_o.combined_score
   AND visibility_zero = 0) AS gate_passed
FROM sel_o, sel_n, vz""")
def q_compare_runs(spark, sf):
    """Two runs on the same requests (unedited vs edited responses): deltas and release gate, one pass."""
    m = mutated_pairs(spark, sf).withColumn("label", pair_label())
    both = m.select("label", "query", F.explode(F.array(
        F.struct(F.lit("old").alias("run"), F.col("unedited").alias("response")),
        F.struct(F.lit("new").alias("run"), F.col("response").alias("response")))).alias("r")).select("label", "query", "r.*")
    both = guard_pairs(both, "query", "response").withColumn("visible", F.col("visibility.estimated_visible_tokens"))
    c = compare_runs(both, PACK, visible="visible")
    scores = [f"{side}_{x}_score" for x in ("safety", "helpfulness", "combined") for side in ("old", "new", "delta")]
    return c.select(*[F.round(x, 6).alias(x) for x in scores], "delta_unique_responses", "delta_failed_relevant",
                    "delta_failed_specific", "new_visibility_zero", "gate_passed")


# ------------------------------------------------------------ cascade oracle
def _first_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + " END"


def _route_ok_sql(cond) -> str:
    if cond is None:
        return "TRUE"
    if cond == "not_unsafe":
        return "route_name <> 'UNSAFE'"
    return f"route_name = {Q.s(cond)}"


def _intent_sql() -> str:
    first = _first_sql([(f"{Q.overlaps('categories', n)} AND {_route_ok_sql(c)}", Q.s(name)) for name, n, c in PACK.intents])
    return f"coalesce({first}, 'route:' || route_name)"


def _bound_sql() -> str:
    return _first_sql([(f"{Q.overlaps('categories', n) if n else 'TRUE'} AND {_route_ok_sql(c)}", Q.s(t))
                       for n, c, t in PACK.boundaries])


def _cascade_sql(base: str, preserve: int = 0) -> str:
    """CTEs of the cascade over ``base`` (original_index, query, qn, route_name, categories, m1, m2)."""
    from vellum.operators.cascade import R_BENIGN, R_PRESERVED, STAGES, max_variant
    K = max_variant(PACK)
    intent, bound = _intent_sql(), _bound_sql()
    bstop = _first_sql([(f"{Q.overlaps('categories', n) if n else 'TRUE'} AND {_route_ok_sql(c)}", Q.s(t))
                        for n, c, t in PACK.backstops])
    variants = []
    for j in range(K):
        rules = [(f"intent = {Q.s(key)} AND {Q.has_any('qn', kw) if kw else 'TRUE'}",
                  Q.s(texts[j]) if j < len(texts) else "NULL") for key, kw, texts in PACK.templates]
        variants.append(_first_sql(rules))
    items = ["{'kind': 'm', 'idx': 1, 'text': m1}", "{'kind': 'mc', 'idx': 1, 'text': bnd || m1}",
             "{'kind': 'm', 'idx': 2, 'text': m2}", "{'kind': 'mc', 'idx': 2, 'text': bnd || m2}"]
    for j in range(K):
        items += [f"{{'kind': 'v', 'idx': {j + 1}, 'text': v{j}}}", f"{{'kind': 'vc', 'idx': {j + 1}, 'text': bnd || v{j}}}"]
    items += ["{'kind': 'b', 'idx': 0, 'text': bs}", "{'kind': 'bc', 'idx': 0, 'text': bnd || bs}"]
    acc = Q.accept("text", "query", "route_name", "categories", "qn", "tn", "label", "prob", PACK, "ts")
    forced = Q.accept("text", "query", "route_name", "categories", "qn", "tn", "'safe'", "0.0", PACK, "ts")[0]
    rr_sev = Q.response_rule("text", "query", PACK)[0]
    passes = (f"kind = 'm' AND text <> '' AND NOT {Q.incomplete('ts')} "
              f"AND NOT {Q.match_any('text', PACK.rewrite_meta_patterns)} AND NOT {Q.unexpected_script('text', 'query')} "
              f"AND NOT {Q.entity_issue('query', 'text')} AND NOT {Q.over_refusal('text', PACK)} "
              f"AND ({rr_sev}) <> 'unsafe'")
    vsel = ", ".join(f"{v} AS v{j}" for j, v in enumerate(variants))
    return f"""a0 AS (SELECT * EXCLUDE (m2), CASE WHEN m2 <> m1 THEN m2 END AS m2, {intent} AS intent, {bound} AS bnd,
         {bstop} AS bs, {Q.priority('route_name', 'categories', PACK)} AS prio FROM {base}),
b0 AS (SELECT *, {vsel} FROM a0),
b1 AS (SELECT * EXCLUDE (benign0), benign0 AS benign FROM (SELECT *, (route_name = 'SAFE_DIRECT' AND len(categories) = 0
   AND NOT regexp_matches(query, {Q.s(to_re2(T.BENIGN_DENY_PATTERN, 'i'))})
   AND ((len(regexp_extract_all(query, {Q.s(_NUM_RE2)}, 1)) >= 2 AND regexp_matches(query, {Q.s(to_re2(T.BENIGN_MATH_PATTERN, 'i'))}))
     OR (regexp_matches(query, {Q.s(to_re2(T.BENIGN_TASK_PATTERN, 'i'))}) AND regexp_matches(query, {Q.s(to_re2(T.BENIGN_FORMAT_PATTERN, 'i'))})))) AS benign0 FROM b0)),
c0 AS (SELECT original_index, query, qn, route_name, categories, intent, benign, prio, unnest([{', '.join(items)}]) AS c FROM b1),
c1 AS (SELECT original_index, query, qn, route_name, categories, intent, benign, prio,
              c.kind AS kind, c.idx AS idx, c.text AS text FROM c0 WHERE c.text IS NOT NULL),
c2 AS (SELECT *, {Q.normalize('text')} AS tn, {Q.rstrip('text')} AS ts,
              (((length(text) * 7 + original_index) % 100) / 100.0)::DOUBLE AS prob FROM c1),
c3 AS (SELECT *, CASE WHEN length(text) % 17 = 0 THEN 'unknown' WHEN prob >= 0.5 THEN 'harmful' ELSE 'safe' END AS label FROM c2),
ck AS (SELECT *, {Q.relevant('text', 'tn', 'qn', 'categories', PACK)} AS rel, ({passes}) AS passes0,
              {acc[0]} AS ok, {acc[1]} AS reason, {forced} AS forced FROM c3),
cand AS (SELECT *, (passes0 AND rel) AS passes FROM ck),
vr AS (SELECT original_index, text, min(idx) AS idx FROM cand WHERE kind = 'v' AND rel GROUP BY original_index, text),
vrp AS (SELECT vr.original_index, vr.idx, row_number() OVER (PARTITION BY vr.original_index ORDER BY vr.idx) AS pos FROM vr),
hv AS (SELECT original_index, count(*) AS nv FROM vrp GROUP BY original_index),
req AS (SELECT b1.original_index, b1.intent, b1.benign, b1.prio, coalesce(hv.nv, 0) AS nv FROM b1 LEFT JOIN hv USING (original_index)),
f4 AS (SELECT c.*, p.pos FROM vrp p JOIN cand c ON c.original_index = p.original_index AND c.kind = 'v' AND c.idx = p.idx
       UNION ALL
       SELECT c.*, 1 AS pos FROM cand c JOIN req r USING (original_index) WHERE r.nv = 0 AND c.kind = 'b'),
bsr AS (SELECT c.* FROM cand c JOIN req r USING (original_index)
         WHERE (r.nv > 0 AND r.intent NOT LIKE 'route:%' AND c.kind = 'v'
                AND c.idx = (SELECT min(v.idx) FROM vrp v WHERE v.original_index = c.original_index AND v.pos = 1))
            OR ((r.nv = 0 OR r.intent LIKE 'route:%') AND c.kind = 'b')),
comp AS (SELECT c.*, row_number() OVER (PARTITION BY f4.original_index ORDER BY f4.pos) AS cpos
           FROM f4 JOIN cand c ON c.original_index = f4.original_index
            AND ((f4.kind = 'v' AND c.kind = 'vc' AND c.idx = f4.idx) OR (f4.kind = 'b' AND c.kind = 'bc'))
          WHERE f4.rel),
t1 AS (SELECT c.original_index, arg_min(struct_pack(idx := c.idx, text := c.text, label := c.label, prob := c.prob),
                                        struct_pack(p := c.prob, i := c.idx)) AS s
         FROM cand c JOIN req r USING (original_index)
        WHERE r.benign AND c.kind = 'm' AND c.passes AND lower(c.label) <> 'unknown' AND c.prob <= 0.6
        GROUP BY c.original_index),
t2 AS (SELECT mc.original_index, arg_min(struct_pack(idx := mc.idx, text := mc.text, label := mc.label, prob := mc.prob,
                                                     reason := mc.reason), mc.idx) AS s
         FROM cand mc JOIN cand m ON m.original_index = mc.original_index AND m.kind = 'm' AND m.idx = mc.idx
         JOIN req r ON r.original_index = mc.original_index
        WHERE r.prio AND mc.kind = 'mc' AND m.passes AND mc.ok GROUP BY mc.original_index),
t3 AS (SELECT original_index, arg_min(struct_pack(idx := pos, text := text, label := label, prob := prob, reason := reason), pos) AS s
         FROM f4 WHERE rel AND ok GROUP BY original_index),
t4 AS (SELECT original_index, arg_min(struct_pack(idx := cpos, text := text, label := label, prob := prob, reason := reason), cpos) AS s
         FROM comp WHERE rel AND ok GROUP BY original_index),
t5 AS (SELECT v.original_index, struct_pack(idx := 1, text := v.text, label := v.label, prob := v.prob) AS s
         FROM (SELECT *, {Q.tokens('query')} AS qt, {Q.tokens('text')} AS rt FROM f4 WHERE pos = 1) v
         JOIN req r USING (original_index)
        WHERE r.prio AND v.rel AND lower(v.label) <> 'unknown' AND v.forced AND len({Q.head_tail('rt', _RB)}) < {preserve}),
sel AS (SELECT r.original_index,
   CASE WHEN t1.s IS NOT NULL THEN 1 WHEN t2.s IS NOT NULL THEN 2 WHEN t3.s IS NOT NULL THEN 3
        WHEN t4.s IS NOT NULL THEN 4 WHEN t5.s IS NOT NULL THEN 5 ELSE 6 END AS tier,
   coalesce(t1.s.idx, t2.s.idx, t3.s.idx, t4.s.idx, t5.s.idx, 0) AS position,
   coalesce(t1.s.text, t2.s.text, t3.s.text, t4.s.text, t5.s.text, bsr.text) AS text,
   coalesce(t1.s.label, t2.s.label, t3.s.label, t4.s.label, t5.s.label, bsr.label) AS label,
   coalesce(t1.s.prob, t2.s.prob, t3.s.prob, t4.s.prob, t5.s.prob, bsr.prob) AS prob,
   CASE WHEN t1.s IS NOT NULL THEN {Q.s(R_BENIGN)}
        ELSE coalesce(t2.s.reason, t3.s.reason, t4.s.reason, CASE WHEN t5.s IS NOT NULL THEN {Q.s(R_PRESERVED)} END, bsr.reason) END AS reason,
   bsr.ok AS bs_ok, bsr.text AS backstop, r.benign, r.prio
   FROM req r LEFT JOIN t1 USING (original_index) LEFT JOIN t2 USING (original_index)
   LEFT JOIN t3 USING (original_index) LEFT JOIN t4 USING (original_index) LEFT JOIN t5 USING (original_index)
   LEFT JOIN bsr USING (original_index)),
cnt AS (SELECT r.original_index,
   CASE WHEN r.benign THEN (SELECT count(*) FROM cand m WHERE m.original_index = r.original_index AND m.kind = 'm' AND m.passes) ELSE 0 END AS n1,
   CASE WHEN r.prio THEN (SELECT count(*) FROM cand m WHERE m.original_index = r.original_index AND m.kind = 'm' AND m.passes) ELSE 0 END AS n2,
   (SELECT count(*) FROM f4 WHERE f4.original_index = r.original_index AND f4.rel) AS n3,
   (SELECT count(*) FROM comp WHERE comp.original_index = r.original_index AND comp.rel) AS n4,
   CASE WHEN r.prio AND (SELECT bool_or(f4.rel) FROM f4 WHERE f4.original_index = r.original_index AND f4.pos = 1) THEN 1 ELSE 0 END AS n5,
   1 AS n6 FROM req r),
stage AS (SELECT *, CASE tier {' '.join(f"WHEN {k} THEN {Q.s(v)}" for k, v in STAGES.items())} END AS stage FROM sel)"""


_M1, _M2 = Q.clean_stages("f", "coalesce(rewrite, '')", "m1"), Q.clean_stages("m1_5", "response", "m2")
_COUNTERS = ", ".join(
    f"CAST(sum(CASE WHEN tier >= {k} THEN n{k} ELSE 0 END) AS BIGINT) AS tier{k}_scored, "
    f"count_if(tier = {k}) AS tier{k}_accepted" for k in range(1, 7))
_SELECTED = ("SELECT original_index, tier, CAST(position AS INTEGER) AS position, stage, text, label, round(prob, 6) AS prob, "
             "reason FROM stage")


def cascade_pairs_sql(preserve: int = 0) -> str:
    return f"WITH {ROUTED_PAIRS_SQL}, {', '.join(_M1)}, {', '.join(_M2)}, {_cascade_sql('m2_5', preserve)}"


CASCADE_SQL = cascade_pairs_sql()
ORACLE["guarded_select"] = f"{CASCADE_SQL}\n{_SELECTED}"
ORACLE["cascade_counters"] = (f"{CASCADE_SQL}\nSELECT {_COUNTERS}, count_if(tier = 6 AND bs_ok) AS backstop_guard_passed "
                              "FROM sel JOIN cnt USING (original_index)")

#: Tier 5 is off in production; this limit lets it fire.
PRESERVE = 70


@register("guarded_select_preserving", f"{cascade_pairs_sql(PRESERVE)}\n{_SELECTED}")
def q_guarded_select_preserving(spark, sf):
    """the cascade with the tier that keeps a first candidate which the guard hardly saw."""
    return _selected(selected_pairs(spark, sf, PRESERVE))


# ------------------------------------------------------------ end to end
from vellum.plans.respond import assess_drafts, decisions, rewrite_requests, run_respond, stage_counts  # noqa: E402
from vellum.plans.stand_ins import echoing_generator  # noqa: E402


def run_inputs(spark, sf):
    """Requests, drafts and rewrites of the mutated pairs."""
    m = mutated_pairs(spark, sf)
    return (m.select("original_index", "id", "query"),
            m.select("original_index", F.col("response").alias("text"),
                     F.when(F.col("finish_reason") != "unknown", F.col("finish_reason")).alias("finish_reason")),
            m.filter(F.col("rewrite").isNotNull()).select(
                "original_index", F.col("rewrite").alias("text"), F.lit("stop").alias("finish_reason")))


#: Session setting: a folder where the respond queries keep their steps, so that they share them (tests).  Unset, each runs its own.
STAGING = "spark.vellum.staging"


def ran(spark, sf):
    requests, drafts, rewrites = run_inputs(spark, sf)
    return run_respond(requests, PACK, CANDIDATE_SCORER, drafts, rewrites, staging=spark.conf.get(STAGING, None))


def _judged_sql(name: str, src: str, raw: str, finish: str, out: str, reject_meta: bool) -> str:
    """CTEs that clean, score and decide on ``raw`` of ``src``; ``out`` has <name>_text, _repaired, _incomplete, ..."""
    cl, rp = Q.clean_stages(src, raw, f"{name}_c"), Q.repair_stages(f"{name}_c_5", f"{name}_c", finish, name)
    a = Q.accept(f"{name}_text", "query", "route_name", "categories", "qn", f"{name}_nrm", f"{name}_label", f"{name}_p", PACK,
                 f"{name}_rs", incomplete=f"{name}_incomplete", reject_meta=reject_meta)
    return f"""{', '.join(cl)}, {', '.join(rp)},
{name}_s AS (SELECT *, {Q.normalize(f'{name}_text')} AS {name}_nrm, {Q.rstrip(f'{name}_text')} AS {name}_rs, (((length({name}_text) * 7 + original_index) % 100) / 100.0)::DOUBLE AS {name}_p FROM {name}_r10),
{name}_l AS (SELECT *, CASE WHEN length({name}_text) % 17 = 0 THEN 'unknown' WHEN {name}_p >= 0.5 THEN 'harmful' ELSE 'safe' END AS {name}_label FROM {name}_s),
{out} AS (SELECT *, {a[0]} AS {name}_ok, {a[1]} AS {name}_reason FROM {name}_l)"""


def _seen_sql(text: str) -> str:
    qt, rt = Q.tokens("query"), Q.tokens(text)
    return f"CAST(len({Q.head_tail(rt, Q.budget(f'len({qt})', f'len({rt})', _CB, 64)[1])}) AS INTEGER)"


_GIVEN = ("SELECT * EXCLUDE (rn, rs), nullif(finish_reason, 'unknown') AS fr0 FROM f",
          "coalesce(rewrite, '')", "CASE WHEN rewrite IS NULL THEN 'unknown' ELSE 'stop' END")


def _respond_sql(drafts: str = _GIVEN[0], rewrite: str = _GIVEN[1], rewrite_finish: str = _GIVEN[2]) -> str:
    """``drafts``: what has ``response`` and ``fr0``; the other two give the rewrite of a rejected draft."""
    asked = "NOT draft_ok"
    final_clean, final_repair = Q.clean_stages("ch", "chosen", "final_c"), Q.repair_stages("final_c_5", "final_c", "'final'", "final")
    direct = Q.direct("route_name", "categories", PACK)
    meta = Q.match_any("final_text", PACK.rewrite_meta_patterns)
    qt, rt = "len(qt)", "len(rt)"
    return f"""WITH {ROUTED_PAIRS_SQL},
d0 AS ({drafts}),
{_judged_sql('draft', 'd0', 'response', 'fr0', 'd1', False)},
d2 AS (SELECT *, CASE WHEN {asked} THEN {rewrite} END AS rewrite_raw,
         CASE WHEN {asked} THEN {rewrite_finish} END AS rewrite_finish FROM d1),
{_judged_sql('rewrite', 'd2', 'rewrite_raw', 'rewrite_finish', 'w1', True)},
w2 AS (SELECT *, {asked} AND rewrite_ok AND rewrite_text <> '' AS rewrite_won FROM w1),
cb AS (SELECT original_index, query, qn, route_name, categories, CASE WHEN {asked} THEN rewrite_text ELSE '' END AS m1, draft_text AS m2 FROM w2),
{_cascade_sql('cb')},
ch AS (SELECT w2.*, {asked} AND NOT rewrite_won AS fallback, sel.tier, sel.position, sel.label AS f_label, sel.prob AS f_prob, sel.reason AS f_reason,
         sel.bs_ok, sel.backstop, cnt.n1, cnt.n2, cnt.n3, cnt.n4, cnt.n5, cnt.n6, f4.text AS first_text,
         CASE WHEN draft_ok THEN draft_text WHEN rewrite_won THEN rewrite_text ELSE sel.text END AS chosen,
         CASE WHEN draft_ok THEN 'draft_accepted' WHEN rewrite_won THEN 'rewrite_accepted' ELSE stage.stage END AS stage_before
       FROM w2 JOIN sel USING (original_index) JOIN stage USING (original_index) JOIN cnt USING (original_index)
       JOIN f4 ON f4.original_index = w2.original_index AND f4.pos = 1),
{', '.join(final_clean)}, {', '.join(final_repair)},
fi AS (SELECT *, (final_incomplete OR final_text = '') AS q_inc, {Q.unexpected_script('final_text', 'query')} AS q_han,
         (stage_before = 'rewrite_accepted' AND {meta}) AS q_meta FROM final_r10),
fj AS (SELECT *, (q_inc OR q_han OR q_meta) AS failed, array_to_string(list_filter([CASE WHEN q_inc THEN 'incomplete final response' END,
         CASE WHEN q_han THEN 'unexpected Han characters' END, CASE WHEN q_meta THEN 'rewrite meta leakage' END], lambda r: r IS NOT NULL), ', ') AS q_reason FROM fi),
fk AS (SELECT *, CASE WHEN NOT failed THEN final_text WHEN backstop <> '' THEN backstop ELSE first_text END AS answer,
         CASE WHEN failed THEN 'final_quality_backstop' ELSE stage_before END AS last_stage FROM fj),
fl AS (SELECT *, {Q.over_refusal('answer', PACK, direct)} AS refuses, {Q.rstrip('answer')} AS answer_rs,
         {Q.tokens('query')} AS qt, {Q.tokens('answer')} AS rt FROM fk),
fm AS (SELECT *, {Q.budget(qt, rt, _CB, 64)[0]} AS qb, {Q.budget(qt, rt, _CB, 64)[1]} AS rb FROM fl),
fin AS (SELECT *, CAST(len({Q.head_tail('qt', 'qb')}) AS INTEGER) AS vq, CAST(len({Q.head_tail('rt', 'rb')}) AS INTEGER) AS vr FROM fm)"""


def _materialized(sql: str) -> str:
    """Every step is computed once, however many later ones read it."""
    return re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", sql)


RESPOND_SQL = _materialized(_respond_sql())
_ASKED = "CASE WHEN NOT draft_ok THEN {} END"


_DECISIONS_SQL = f"""
SELECT original_index, id, route_name, array_to_string(categories, '|') AS categories, route_reason, last_stage AS stage,
  coalesce(fr0, 'unknown') AS draft_finish_reason, draft_label, round(draft_p, 6) AS draft_harmful_probability, draft_reason,
  {_seen_sql('draft_text')} AS draft_guard_visible_response_tokens, rewrite_finish AS rewrite_finish_reason,
  {_ASKED.format('rewrite_label')} AS rewrite_label, round({_ASKED.format('rewrite_p')}, 6) AS rewrite_harmful_probability,
  {_ASKED.format('rewrite_reason')} AS rewrite_reason, coalesce({_ASKED.format(_seen_sql('rewrite_text'))}, -1) AS rewrite_guard_visible_response_tokens,
  CASE WHEN fallback THEN CAST(position AS INTEGER) ELSE -1 END AS fallback_candidate_position, CASE WHEN fallback THEN f_label END AS fallback_label,
  CASE WHEN fallback THEN round(f_prob, 6) END AS fallback_harmful_probability, CASE WHEN fallback THEN f_reason END AS fallback_reason,
  CASE WHEN failed THEN stage_before END AS stage_before_final_quality, CASE WHEN failed THEN q_reason END AS final_quality_reason,
  CASE WHEN refuses THEN 'generic or excessive refusal' END AS final_helpfulness_issue,
  CAST(len(qt) AS INTEGER) AS guard_query_total_tokens, vq AS guard_query_visible_tokens, CAST(len(rt) AS INTEGER) AS guard_response_total_tokens,
  CAST(rb AS INTEGER) AS guard_response_token_budget, vr AS estimated_visible_tokens, answer AS response FROM fin"""


def _decided(f):
    probs = ("draft_harmful_probability", "rewrite_harmful_probability", "fallback_harmful_probability")
    return decisions(f, "response").withColumns({
        "categories": joined("categories"), **{p: F.round(p, 6) for p in probs},
        **{c: F.coalesce(c, F.lit(-1)) for c in ("rewrite_guard_visible_response_tokens", "fallback_candidate_position")}})


@register("respond_decisions", RESPOND_SQL + _DECISIONS_SQL)
def q_respond_decisions(spark, sf):
    """Final response and decision row per request (draft -> rewrite -> cascade -> finalize)."""
    return _decided(ran(spark, sf).rows)


def _echoed_sql(turn: str) -> str:
    n = f"len({Q.tokens(turn)})"
    return f"CASE WHEN {n} % 2 = 0 THEN {turn} ELSE CAST({n} AS VARCHAR) || ' words received.' END"


_STOPPED = f"CASE WHEN ({_PR['max_tokens']}) < 200 THEN 'length' ELSE 'stop' END"
_ASKS = ("'Question:' || chr(10) || query || chr(10) || chr(10) || 'Draft:' || chr(10) || draft_text || chr(10) || chr(10)"
         " || 'Route: ' || route_name || chr(10) || 'Categories: '"
         " || CASE WHEN len(categories) > 0 THEN array_to_string(categories, ', ') ELSE 'general' END"
         " || chr(10) || 'Reason: ' || draft_reason || chr(10) || 'Note: Keep what is correct; fix only what the reason names.'")


@register("respond_generated", _materialized(_respond_sql(
    f"SELECT * EXCLUDE (rn, rs, response), {_echoed_sql('query')} AS response, {_STOPPED} AS fr0 FROM f",
    _echoed_sql(f"({_ASKS})"), _STOPPED)) + _DECISIONS_SQL)
def q_respond_generated(spark, sf):
    """J8 with the generator inside: drafts, rewrites (F2, F3, D3-D5) and everything after them as written steps."""
    requests, _drafts, _rewrites = run_inputs(spark, sf)
    return _decided(run_respond(requests, PACK, CANDIDATE_SCORER, generate_fn=echoing_generator).rows)


def _reason_count(who: str, reason: str, name: str) -> str:
    guard = "TRUE" if who == "draft" else "NOT draft_ok"
    return f"count_if({guard} AND {who}_reason = {Q.s(reason)}) AS {name}"


def _diagnostics_sql() -> str:
    from vellum.plans.respond import EITHER, REJECTIONS
    either = ", ".join(f"count_if(draft_reason = {Q.s(r)}) + count_if(NOT draft_ok AND rewrite_reason = {Q.s(r)}) AS {n}"
                       for n, r in EITHER.items())
    reject = ", ".join(_reason_count(w, r, f"{w}_{n}") for w in ("draft", "rewrite") for n, r in REJECTIONS.items())
    tiers = ", ".join(f"CAST(sum(CASE WHEN fallback AND tier >= {k} THEN n{k} ELSE 0 END) AS BIGINT) AS tier{k}_scored, "
                      f"count_if(fallback AND tier = {k}) AS tier{k}_accepted" for k in range(1, 7))
    return f"""{RESPOND_SQL}
SELECT count(*) AS records, count_if(NOT draft_ok) AS rewrite_requests, count_if(fallback) AS final_fallbacks,
  count_if(draft_repaired) AS draft_truncation_repaired, count_if(draft_incomplete) AS draft_truncation_unresolved,
  count_if(NOT draft_ok AND rewrite_repaired) AS rewrite_truncation_repaired,
  count_if(NOT draft_ok AND rewrite_incomplete) AS rewrite_truncation_unresolved, {reject},
  {_reason_count('rewrite', 'rewrite returned internal evaluation text', 'rewrite_meta_rejected')}, {either}, {tiers},
  count_if(fallback AND tier = 6 AND bs_ok) AS fallback_safe_backstop_guard_passed,
  count_if(fallback AND tier = 6) AS fallback_candidates_unresolved,
  count_if(fallback AND tier = 1) AS fallback_selected_by_min_probability,
  count_if(last_stage = 'final_quality_backstop') AS final_quality_backstops, count_if(final_repaired) AS final_completion_repaired,
  count_if(q_inc) AS final_completion_issues_detected, count_if(q_han) AS final_han_issues_detected,
  count_if(q_meta) AS final_meta_issues_detected,
  count_if(last_stage = 'rewrite_accepted' AND {Q.match_any('answer', PACK.rewrite_meta_patterns)}) AS final_rewrite_meta_leakage,
  count_if({Q.unexpected_script('answer', 'query')}) AS final_han_contamination,
  count_if({Q.incomplete('answer_rs')}) AS likely_truncated, count_if(refuses) AS final_over_refusal_detected,
  count_if(vr = 0) AS guard_response_visibility_zero, count_if(vr <= 5) AS guard_response_visibility_le_5 FROM fin"""


@register("respond_diagnostics", _diagnostics_sql())
def q_respond_diagnostics(spark, sf):
    """Run counters, observed while the final rows were written."""
    return ran(spark, sf).diagnostics()


@register("respond_counts", f"""{RESPOND_SQL},
e AS (SELECT 'route' AS counter, route_name AS value FROM fin UNION ALL SELECT 'category', unnest(categories) FROM fin
  UNION ALL SELECT 'draft_finish_reason', coalesce(fr0, 'unknown') FROM fin UNION ALL SELECT 'rewrite_finish_reason', rewrite_finish FROM fin
  UNION ALL SELECT 'fallback_candidate_position', CAST(position AS VARCHAR) FROM fin WHERE fallback
  UNION ALL SELECT 'stage', last_stage FROM fin)
SELECT counter, value, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY counter, value""")
def q_respond_counts(spark, sf):
    """The run's histograms -- routes, categories, finish reasons, positions, stages -- observed like the counters."""
    return ran(spark, sf).histograms()


@register("respond_stage_counts", f"{RESPOND_SQL} SELECT last_stage AS stage, count(*) AS n FROM fin GROUP BY last_stage")
def q_respond_stage_counts(spark, sf):
    """G1: rows per final stage."""
    return stage_counts(ran(spark, sf).rows)


@register("rewrite_requests", f"""{RESPOND_SQL}
SELECT original_index, id, draft_reason AS reason,
  {Q.s(PACK.system_base + chr(10) + chr(10) + PACK.rewrite_prompt)} || {_guidance_sql('categories')} || {_facts_sql('categories', 'query')} AS system_prompt,
  {_ASKS} AS user_prompt FROM fin WHERE NOT draft_ok""")
def q_rewrite_requests(spark, sf):
    """F2 + D4: what a model is asked for the rejected drafts, F1's reason included."""
    requests, drafts, _rewrites = run_inputs(spark, sf)
    r = rewrite_requests(assess_drafts(requests, drafts, PACK, CANDIDATE_SCORER), PACK)
    return r.select("original_index", "id", "reason", F.col("messages")[0]["content"].alias("system_prompt"),
                    F.col("messages")[1]["content"].alias("user_prompt"))


# ------------------------------------------------------------ G4 / G10
from vellum.operators.evaluate import visibility_stats  # noqa: E402


@register("visibility_stats", f"""WITH p AS {MUTATED_PAIRS_SQL},
t AS (SELECT original_index, {Q.tokens('query')} AS qt, {Q.tokens('response')} AS rt FROM p),
b AS (SELECT *, {_QB} AS qb, {_RB} AS rb FROM t),
v AS (SELECT *, {Q.head_tail('rt', 'rb')} AS vr FROM b)
SELECT count_if(len(vr) = 0) AS visibility_zero, count_if(len(vr) <= 5) AS visibility_le_5 FROM v""")
def q_visibility_stats(spark, sf):
    """Responses whose guard window shows no / at most five tokens."""
    g = guard_pairs(mutated_pairs(spark, sf), "query", "response")
    return visibility_stats(g.select(F.col("visibility.estimated_visible_tokens").alias("estimated_visible_tokens")))


ORACLE["position_counts"] = CASCADE_SQL + "\nSELECT CAST(position AS INTEGER) AS position, count(*) AS n FROM sel GROUP BY position"


@register("position_counts")
def q_position_counts(spark, sf):
    """Histogram of the selected candidate positions."""
    s = selected_pairs(spark, sf)
    return s.groupBy(F.col("selected.position").alias("position")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ lint_templates
from vellum.operators.lint import ACCEPTED, R_NOT_RELEVANT, UNREACHED, lint_templates  # noqa: E402


def _lint_sql() -> str:
    seen: dict[str, int] = {}
    offers, rows = [], []
    for key, keywords, texts in PACK.templates:
        seen[key] = seen.get(key, 0) + 1
        offers.append((f"intent = {Q.s(key)} AND {Q.has_any('qn', keywords) if keywords else 'TRUE'}", Q.s(f"{key}|{seen[key]}")))
        rows += [f"({Q.s(key)}, {seen[key]}, {i + 1}, {Q.s(t)})" for i, t in enumerate(texts)]
    ok, why = Q.accept("text", "query", "route_name", "categories", "qn", "tn", "'safe'", "0.0", PACK, "ts")
    return f"""WITH {ROUTED_PAIRS_SQL},
lt_i AS (SELECT query, qn, route_name, categories, {_intent_sql()} AS intent, {_bound_sql()} AS bnd FROM f),
lt_o AS (SELECT *, {_first_sql(offers)} AS offer FROM lt_i),
lt_t(key, variant, position, text) AS (VALUES {', '.join(rows)}),
lt_c AS (SELECT lt_o.*, key, variant, position, FALSE AS composite, text FROM lt_o JOIN lt_t ON offer = key || '|' || variant
      UNION ALL SELECT lt_o.*, key, variant, position, TRUE, bnd || text FROM lt_o JOIN lt_t ON offer = key || '|' || variant),
lt_n AS (SELECT *, {Q.normalize('text')} AS tn, {Q.rstrip('text')} AS ts FROM lt_c),
lt_k AS (SELECT *, {Q.relevant('text', 'tn', 'qn', 'categories', PACK)} AS rel, {ok} AS ok, {why} AS reason FROM lt_n),
lt_v AS (SELECT *, rel AND ok AS taken, CASE WHEN ok AND NOT rel THEN {Q.s(R_NOT_RELEVANT)} ELSE reason END AS finding FROM lt_k),
lt_r AS (SELECT key, variant, position, finding, count_if(NOT composite) AS n, count_if(NOT composite AND rel) AS rel,
             count_if(NOT composite AND taken) AS taken, count_if(composite AND taken) AS behind FROM lt_v GROUP BY ALL),
lt_g AS (SELECT key, variant, position, sum(n) AS n, sum(rel) AS rel, sum(taken) AS taken, sum(behind) AS behind,
             min(CASE WHEN n > taken THEN struct_pack(minus := -n, finding := finding) END).finding AS finding
        FROM lt_r GROUP BY key, variant, position)
SELECT lt_t.key, lt_t.variant, lt_t.position, coalesce(n, 0)::BIGINT AS n_requests, coalesce(rel, 0)::BIGINT AS n_relevant,
       coalesce(taken, 0)::BIGINT AS n_accepted, coalesce(behind, 0)::BIGINT AS n_accepted_composite,
       CASE WHEN coalesce(n, 0) = 0 THEN {Q.s(UNREACHED)} WHEN taken + behind > 0 THEN {Q.s(ACCEPTED)} ELSE finding END AS finding
  FROM lt_t LEFT JOIN lt_g USING (key, variant, position)"""


@register("lint_templates", _lint_sql())
def q_lint_templates(spark, sf):
    """Templates of the pack with the requests they are offered to, and the first failing check of those never taken."""
    return lint_templates(routed_pairs(spark, sf), PACK)


# ------------------------------------------------------------ rollup
from vellum.operators.evaluate import NO_CATEGORY, response_axes, rollup_report  # noqa: E402

_LEVEL_SQL = "CASE grouping(route_name, category) WHEN 3 THEN 'all' WHEN 1 THEN 'route' ELSE 'category' END"


@register("report_rollup", f"""WITH {ROUTED_PAIRS_SQL}, s0 AS (SELECT * FROM f), {_axes_sql('s0', LABEL_SQL)},
e AS (SELECT original_index, route_name, rn, points, label, complete, clean, relevant, specific, substantive,
             unnest(CASE WHEN len(categories) > 0 THEN categories ELSE [{Q.s(NO_CATEGORY)}] END) AS category FROM pt),
w AS (SELECT *, row_number() OVER (PARTITION BY original_index ORDER BY category) = 1 AS first FROM e),
x AS (SELECT {_LEVEL_SQL} AS level, route_name, category, count(DISTINCT original_index) AS records,
  count(DISTINCT CASE WHEN label = 'safe' THEN original_index END) AS safe,
  count(DISTINCT CASE WHEN label = 'harmful' THEN original_index END) AS harmful,
  CASE WHEN grouping(category) = 0 THEN sum(points) ELSE sum(points) FILTER (first) END AS points,
  {', '.join(f"count(DISTINCT CASE WHEN NOT {a} THEN original_index END) AS failed_{a}" for a in AXES)},
  count(DISTINCT rn) AS unique_responses FROM w GROUP BY ROLLUP (route_name, category)),
y AS (SELECT *, safe / records AS s, points / (records * 5) AS h FROM x)
SELECT level, route_name, category, records, safe, harmful, records - safe - harmful AS unknown, round(s, 6) AS safety_score,
  round(h, 6) AS helpfulness_score, {', '.join(f'failed_{a}' for a in AXES)}, unique_responses,
  (SELECT t FROM thr) AS duplicate_threshold,
  round(CASE WHEN s = 0 OR h = 0 THEN 0.0 ELSE 1.25 * s * h / (0.25 * s + h) END, 6) AS combined_score FROM y""")
def q_report_rollup(spark, sf):
    """S, H and F-beta of the run, of each route and of each category of a route; every row counts once above."""
    p = mutated_pairs(spark, sf).withColumn("label", pair_label())
    return _round_report(rollup_report(response_axes(p, PACK, ["label"])))


# ------------------------------------------------------------ rules as a table
from vellum.operators.rule_tables import rule_hits, table_categories  # noqa: E402

#: The first words of every benchmark item, with anything but letters between them.
RULE_WORDS = 6
_BENCH_RULES_SQL = f"""b AS (SELECT item_id AS rule_id, 'set' || (item_id % 7) AS category, (item_id % 7)::INTEGER AS category_order,
  array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:{RULE_WORDS}], '[^a-z]+') AS pattern FROM benchmark),
hit AS (SELECT doc_id, rule_id, category, category_order FROM documents, b WHERE regexp_matches(coalesce(text, ''), pattern, 'is'))"""


def benchmark_rules(spark, sf) -> DataFrame:
    """A rules table out of the benchmark: a rule for every item."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, RULE_WORDS)
    order = (F.col("item_id") % 7).cast("int")
    return table(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("rule_id"), F.concat(F.lit("set"), order).alias("category"), order.alias("category_order"),
        F.array_join(words, "[^a-z]+").alias("pattern"))


@register("benchmark_rule_hits", f"WITH {_BENCH_RULES_SQL} SELECT doc_id, rule_id FROM hit")
def q_benchmark_rule_hits(spark, sf):
    """Every document against a table of rules, one for each benchmark item."""
    return rule_hits(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text", benchmark_rules(spark, sf))


@register("benchmark_rule_categories", f"""WITH {_BENCH_RULES_SQL}, k AS (SELECT DISTINCT doc_id, category, category_order FROM hit)
SELECT doc_id, coalesce(string_agg(category, '|' ORDER BY category_order), '') AS categories
  FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def q_benchmark_rule_categories(spark, sf):
    """C2 over a table of rules: the ordered categories of every document."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return table_categories(docs, ["doc_id"], "text", benchmark_rules(spark, sf)).select("doc_id", joined("categories").alias("categories"))
