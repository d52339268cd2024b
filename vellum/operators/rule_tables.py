"""H11 for tables of rules: every text against every pattern of a rules table.

A pack's few rules are unrolled into one ``rlike`` a category (``tagging``).
Thousands of rules don't fit into generated code, so here they stay data: a
block of rules of checked size is broadcast, a worker builds one automaton out
of the literal factors of its patterns, walks each text once, and searches in
full only the patterns of which the text holds a factor.  Rules without a
factor are searched in every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vellum.functions.factors import factors, fold

#: Rules of a block, and bytes of their patterns: what is collected, broadcast and held by a worker.
BLOCK_RULES, BLOCK_BYTES = 20_000, 16 << 20

FLAGS = re.IGNORECASE | re.DOTALL


class Matcher:
    """Patterns by place, searched in the texts that hold one of their factors."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.compiled: dict[int, re.Pattern] = {}
        self.always: list[int] = []
        of: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            own = factors(p)
            if not own:
                self.always.append(i)
            for f in own:
                of.setdefault(f, []).append(i)
        self.automaton = ahocorasick.Automaton() if of else None
        for f, rules in of.items():
            self.automaton.add_word(f, rules)
        if of:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules that may match, in order."""
        found = set(self.always)
        if self.automaton is not None:
            for _end, rules in self.automaton.iter(fold(text)):
                found.update(rules)
        return sorted(found)

    def hits(self, text: str) -> list[int]:
        """Rules that match, in order."""
        out = []
        for i in self.candidates(text):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.patterns[i], FLAGS)
            if self.compiled[i].search(text):
                out.append(i)
        return out


def _collected(rules: DataFrame, rule_id: str, pattern: str) -> tuple[list, list[str]]:
    rows = sorted(rules.select(rule_id, pattern).collect(), key=lambda r: r[0])
    for r in rows:
        if r[1] is None:
            raise ValueError(f"rule {r[0]} has no pattern")
        re.compile(r[1], FLAGS)
    return [r[0] for r in rows], [r[1] for r in rows]


def _searcher(rules: DataFrame, rule_id: str, pattern: str) -> Callable[[Column], Column]:
    """A column function from a text to the sorted array of the ids of its rules; null has none."""
    sent = rules.sparkSession.sparkContext.broadcast(_collected(rules, rule_id, pattern))
    made: list[Matcher] = []  # a worker's own

    @pandas_udf(f"array<{rules.schema[rule_id].dataType.simpleString()}>")
    def search(texts: pd.Series) -> pd.Series:
        ids, patterns = sent.value
        if not made:
            made.append(Matcher(patterns))
        return pd.Series([[ids[i] for i in made[0].hits(t or "")] for t in texts], dtype=object)
    return search


def blocks_of(rules: DataFrame, rule_id: str = "rule_id", pattern: str = "pattern", block_rules: int = BLOCK_RULES,
              block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The rules in blocks of about ``block_rules`` rows and ``block_bytes`` of patterns, dealt by a hash of the id."""
    size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(pattern)), F.lit(0))).first()
    n = max(1, math.ceil(size[0] / block_rules), math.ceil(size[1] / block_bytes))
    return [rules] if n == 1 else [rules.where(F.pmod(F.xxhash64(rule_id), F.lit(n)) == k) for k in range(n)]


def rule_hits(texts: DataFrame, key: list[str], text: str, rules: DataFrame, rule_id: str = "rule_id",
              pattern: str = "pattern", block_rules: int = BLOCK_RULES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key`` columns and ``rule_id``: a row for every text and rule whose pattern occurs in it.

    Patterns are Python's, searched without regard to case, ``.`` matching line
    breaks too (C1).  A null text is an empty one; a rule without a pattern, or with
    one that does not compile, is an error that names it; rules should have ids of
    their own.  A table of more rules than a block holds takes a pass over the texts
    for each block, so a worker never holds more than one block.  No row is shuffled.
    """
    parts = []
    for block in blocks_of(rules, rule_id, pattern, block_rules, block_bytes):
        search = _searcher(block, rule_id, pattern)
        hits = texts.select(*key, search(F.col(text)).alias("_hits"))
        # an inner explode would filter by its argument first, that is, search twice
        parts.append(hits.select(*key, F.explode_outer("_hits").alias(rule_id)).where(F.col(rule_id).isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def with_rule_hits(texts: DataFrame, text: str, rules: DataFrame, name: str = "hits", rule_id: str = "rule_id",
                   pattern: str = "pattern", block_rules: int = BLOCK_RULES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` with the sorted array of the ids of the rules that match; one block of rules only."""
    blocks = blocks_of(rules, rule_id, pattern, block_rules, block_bytes)
    if len(blocks) > 1:
        raise ValueError(f"more than {block_rules} rules or {block_bytes} bytes of patterns: use rule_hits")
    return texts.withColumn(name, _searcher(rules, rule_id, pattern)(F.col(text)))


def table_categories(texts: DataFrame, key: list[str], text: str, rules: DataFrame, **blocks) -> DataFrame:
    """C2 over a rules table (``rule_id, category, category_order, pattern``): ``key`` and the ordered categories of each text.

    Texts without a hit have an empty array.  Hits are ids, joined with the rules' names and
    gathered by key; no text is shuffled.
    """
    named = rule_hits(texts, key, text, rules, **blocks).join(rules.select("rule_id", "category", "category_order"), "rule_id")
    per = named.groupBy(*key).agg(F.transform(F.sort_array(F.collect_set(F.struct("category_order", "category"))),
                                              lambda c: c["category"]).alias("categories"))
    return texts.select(*key).join(per, key, "left").withColumn(
        "categories", F.coalesce("categories", F.array().cast("array<string>")))
