"""J2 tag_and_route: rule tagging (C1-C4), routing (C6), rule-group filters (C10),
response inspection (C5), priority sets (C7, C8) and the count reports (G1, G2).

Rules are compiled from the pack into one ``rlike`` per pattern, asked only of texts
that hold the pattern's literal strings; the tagger is projections with no shuffle
and no join, so it scales with the scan.  The response rules are a first-hit-wins ``when`` chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.factors import needs
from vellum.functions.text import col, compact_text, fold_digits, matches_any, searched
from vellum.packs import Pack

SEVERITIES = ("safe", "controversial", "unsafe")
ROUTES = ("SAFE_DIRECT", "SAFE_SENSITIVE", "UNSAFE")


def empty_array() -> Column:
    return F.array().cast("array<string>")


def _any(text: Column, folded: Column | None, patterns: list[str]) -> Column:
    return matches_any(text, patterns) if folded is None else searched(text, folded, patterns)


def _hits(text: Column, folded: Column | None, groups) -> list[Column]:
    return [F.when(_any(text, folded, pats), F.lit(cat)).otherwise(F.lit("")) for cat, pats in groups]


def _nonnull(cols: list[Column]) -> Column:
    """Ordered hit list.  ``array`` splits its elements into separate generated
    methods and ``array_remove`` has codegen, so large packs stay compiled."""
    if not cols:
        return empty_array()
    return F.array_remove(F.array(*cols), "")


def fold_compact(compact, pack: Pack) -> Column:
    """``fold_digits`` of a compact form (B3): that has small letters and digits only, so it may be its own."""
    asked = [f for _g, on, _c, p in pack.rules if on == "compact" for any_of in needs(p) for f in any_of]
    return fold_digits(compact) if any("0" in f for f in asked) else F.coalesce(col(compact), F.lit(""))


def rule_parts(text, pack: Pack, compact=None, folded=None, compact_folded=None) -> dict[str, Column]:
    """Ordered unsafe hits, ordered sensitive hits and the jailbreak flag.

    With ``folded`` and ``compact_folded``, the ``fold_digits`` of the two texts as columns, a pattern is
    searched only in texts that hold what its matches need."""
    text = col(text)
    compact = compact_text(text) if compact is None else col(compact)
    folded, compact_folded = [c if c is None else col(c) for c in (folded, compact_folded)]
    raw = lambda grp: _hits(text, folded, pack.category_groups(grp, "raw"))
    squeezed = lambda grp: _hits(compact, compact_folded, pack.category_groups(grp, "compact"))
    return {
        "unsafe": F.array_distinct(_nonnull(raw("unsafe") + squeezed("unsafe"))),
        "sensitive": F.array_distinct(_nonnull(raw("sensitive") + squeezed("sensitive"))),
        "jailbreak": (_any(text, folded, pack.patterns("jailbreak", "raw"))
                      | _any(compact, compact_folded, pack.patterns("jailbreak", "compact"))),
    }


def rule_result(unsafe, sensitive, jailbreak) -> Column:
    """struct<severity, categories, looks_like_jailbreak, reason> from the three parts."""
    unsafe, sensitive, jailbreak = col(unsafe), col(sensitive), col(jailbreak)
    has_unsafe, has_sensitive = F.size(unsafe) > 0, F.size(sensitive) > 0
    return F.struct(
        F.when(has_unsafe, "unsafe").when(has_sensitive | jailbreak, "controversial").otherwise("safe").alias("severity"),
        F.when(has_unsafe, F.array_distinct(F.concat(unsafe, sensitive)))
         .when(has_sensitive, sensitive)
         .when(jailbreak, F.array(F.lit("jailbreak")))
         .otherwise(empty_array()).alias("categories"),
        jailbreak.alias("looks_like_jailbreak"),
        F.when(has_unsafe, "direct unsafe request pattern")
         .when(has_sensitive, "sensitive topic pattern")
         .when(jailbreak, "jailbreak-like wording")
         .otherwise("no rule hit").alias("reason"),
    )


def route(rule_result, route_tokens: dict | None = None) -> Column:
    """struct<name, max_tokens, reason, categories> from a rule result struct."""
    r = col(rule_result)
    tokens = route_tokens or {"UNSAFE": 128, "SAFE_SENSITIVE": 224, "SAFE_DIRECT": 384}
    cats = r["categories"]
    joined = F.array_join(cats, ", ")
    unsafe = r["severity"] == "unsafe"
    sensitive = (r["severity"] == "controversial") | r["looks_like_jailbreak"]
    name = F.when(unsafe, "UNSAFE").when(sensitive, "SAFE_SENSITIVE").otherwise("SAFE_DIRECT")
    return F.struct(
        name.alias("name"),
        F.when(unsafe, tokens["UNSAFE"]).when(sensitive, tokens["SAFE_SENSITIVE"])
         .otherwise(tokens["SAFE_DIRECT"]).alias("max_tokens"),
        F.when(unsafe, F.concat(F.lit("unsafe categories: "), joined))
         .when(sensitive, F.concat(F.lit("sensitive categories: "),
                                   F.when(joined == "", "jailbreak").otherwise(joined)))
         .otherwise("safe direct answer").alias("reason"),
        cats.alias("categories"),
    )


def tag_and_route(df: DataFrame, text_col: str, pack: Pack, compact_col: str | None = None, screened: bool = False) -> DataFrame:
    """Add ``rule`` and ``route`` structs plus flat ``categories``/``severity``/``route_name``.

    The hit arrays are projected once into their own columns, so each rule
    regex runs once per row (Catalyst will not inline a non-trivial expression
    that is referenced several times).

    ``screened``: patterns are searched only in texts that hold what their matches need.  That is
    quicker for long texts; the expressions are larger, so it is not for jobs that Spark plans with
    copies of them (the cascade, the lint).
    """
    folded = ()
    if screened:
        df = df.withColumn("_compact", compact_text(text_col) if compact_col is None else col(compact_col))
        df = df.withColumns({"_folded": fold_digits(text_col), "_compact_folded": fold_compact("_compact", pack)})
        compact_col, folded = "_compact", ("_folded", "_compact_folded")
    p = rule_parts(text_col, pack, compact_col, *folded)
    return (df.withColumns({"_unsafe": p["unsafe"], "_sensitive": p["sensitive"], "_jailbreak": p["jailbreak"]})
              .withColumn("rule", rule_result("_unsafe", "_sensitive", "_jailbreak"))
              .drop("_unsafe", "_sensitive", "_jailbreak", "_compact", "_folded", "_compact_folded")
              .withColumn("route", route("rule", pack.route_tokens))
              .withColumn("categories", F.col("rule.categories"))
              .withColumn("severity", F.col("rule.severity"))
              .withColumn("route_name", F.col("route.name")))


def select_by(df: DataFrame, route_name: str | None = None, severity: str | None = None,
              category: str | None = None) -> DataFrame:
    """Requests of a route, severity or category.

    The condition is asked of the tagged rows: as a plain filter Spark would move it below the
    tagging, with a copy of all rules in it, too large to be compiled.  To spare the tagger rows,
    filter by ``may_have`` of the category first."""
    cond = F.lit(True)
    if route_name:
        cond = cond & (F.col("route_name") == route_name)
    if severity:
        cond = cond & (F.col("severity") == severity)
    if category:
        cond = cond & F.array_contains("categories", category)
    kept = F.explode_outer(F.when(cond, F.array(F.lit(True))))
    return df.select("*", kept.alias("_kept")).where("_kept").drop("_kept")


def may_have(text, category: str, pack: Pack, compact=None) -> Column:
    """C10 before the tagger: whether any pattern of a category hits; other rows can't have it."""
    compact = compact_text(text) if compact is None else col(compact)
    of = lambda on: [p for _g, t, c, p in pack.rules if t == on and c == category]
    return matches_any(text, of("raw")) | matches_any(compact, of("compact"))


def query_hits(query, pack: Pack) -> list[Column]:
    """Whether the query pattern of a response rule hits, for the rules that have one."""
    q = F.coalesce(col(query), F.lit(""))
    return [matches_any(q, [query_pat]) for _c, _r, _pat, _not, query_pat, _s in pack.response_rules if query_pat]


def inspect_response(resp, query, pack: Pack, asked: Column | None = None) -> Column:
    """First response rule that hits -> struct<severity, categories, reason>; ``asked``: an array of the ``query_hits``, if a column."""
    from vellum.functions.text import unicode_strip

    r = F.coalesce(col(resp), F.lit(""))
    hits = iter(query_hits(query, pack) if asked is None else [asked[i] for i in range(sum(bool(x[4]) for x in pack.response_rules))])
    chain = None
    for category, reason, pat, not_pat, query_pat, strip in pack.response_rules:
        target = unicode_strip(r) if strip else r
        cond = matches_any(target, [pat])
        if not_pat:
            cond = cond & ~matches_any(r, [not_pat])
        if query_pat:
            cond = next(hits) & cond
        value = F.struct(F.lit("unsafe").alias("severity"), F.array(F.lit(category)).alias("categories"),
                         F.lit(reason).alias("reason"))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    safe = F.struct(F.lit("safe").alias("severity"), empty_array().alias("categories"),
                    F.lit("no response rule hit").alias("reason"))
    return safe if chain is None else chain.otherwise(safe)


def _overlaps(cats: Column, names) -> Column:
    if not names:
        return F.lit(False)
    return F.arrays_overlap(cats, F.array(*[F.lit(n) for n in names])).eqNullSafe(True)


def helpfulness_priority(route_name, categories, pack: Pack) -> Column:
    """The answer must stay on the requested task."""
    cats = col(categories)
    return F.when(col(route_name) == "UNSAFE", _overlaps(cats, pack.priority_unsafe)).otherwise(
        _overlaps(cats, pack.priority))


def requires_direct_answer(route_name, categories, pack: Pack) -> Column:
    """A refusal counts as a failure for this intent."""
    cats = col(categories)
    return F.when(col(route_name) == "UNSAFE", _overlaps(cats, pack.direct_unsafe)).otherwise(
        _overlaps(cats, pack.direct))


def route_counts(df: DataFrame, column: str = "route_name") -> DataFrame:
    """G1: frequency per value (partial aggregation map-side, one shuffle of distinct keys)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, column: str = "categories") -> DataFrame:
    """Frequency per category over array values."""
    # an inner explode would filter by its argument first: Spark moves that below the tagging, with all rules in it
    return (df.select(F.explode_outer(column).alias("category")).where("category is not null")
              .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
