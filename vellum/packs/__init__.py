"""Packs: rule, topic, relevance and template tables as data.

``Pack.load(name)`` reads a pack module.  ``Pack.tables(spark)`` gives all of it
as DataFrames and ``Pack.from_tables`` takes a pack back from such tables,
wherever they are kept (Parquet, CSV...); ``rules_table`` and ``with_rules`` do
so for the query rules alone.  A pack is configuration: the rows of a table are
counted against a bound that the caller sets before they are collected and
compiled into column expressions.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = ("rule_set string, grp string, on_text string, category string, "
               "category_order int, rule_order int, pattern string")

#: Tables of a pack besides the rules: columns behind ``ord``, which keeps the order of the rows.
TABLES = {
    "response_rules": "category string, reason string, pattern string, not_pattern string, query_pattern string, strip boolean",
    "topics": "topic string, keywords array<string>",
    "relevance_rules": "mode string, query_any array<string>, response_any array<string>, head int, min_hits int, "
                       "if_category array<string>, unless_category array<string>, refusal_fails boolean",
    "intents": "intent string, categories array<string>, route string",
    "templates": "key string, keywords array<string>, texts array<string>",
    "boundaries": "categories array<string>, route string, text string",
    "backstops": "categories array<string>, route string, text string",
    "facts": "kind string, trigger array<string>, text string",
}
#: Tables of (ord, name, value): lists by name, and prompt texts by kind and name.
LISTS = ("priority_unsafe", "priority", "direct_unsafe", "direct", "nonanswer_patterns", "rewrite_meta_patterns", "known_generic")
TEXTS = ("system_base", "rewrite_prompt", "guidance_header")
MAPS = ("route_prompts", "guidance", "route_tokens")
NAMED = "name string, item string, value string"


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple = ()
    response_rules: tuple = ()
    topics: tuple = ()
    priority_unsafe: tuple = ()
    priority: tuple = ()
    direct_unsafe: tuple = ()
    direct: tuple = ()
    relevance_rules: tuple = ()
    intents: tuple = ()
    templates: tuple = ()
    boundaries: tuple = ()
    backstops: tuple = ()
    nonanswer_patterns: tuple = ()
    rewrite_meta_patterns: tuple = ()
    known_generic: tuple = ()
    system_base: str = ""
    route_prompts: dict = field(default_factory=dict)
    rewrite_prompt: str = ""
    guidance: dict = field(default_factory=dict)
    guidance_header: str = ""
    facts: tuple = ()
    route_tokens: dict = field(default_factory=dict)

    @classmethod
    def load(cls, name: str = "docs") -> "Pack":
        m = importlib.import_module(f"vellum.packs.{name}")
        return cls(
            name=m.NAME, rules=tuple(m.RULES), response_rules=tuple(m.RESPONSE_RULES),
            topics=tuple((t, tuple(k)) for t, k in m.TOPICS),
            priority_unsafe=tuple(m.PRIORITY_UNSAFE), priority=tuple(m.PRIORITY),
            direct_unsafe=tuple(m.DIRECT_UNSAFE), direct=tuple(m.DIRECT),
            relevance_rules=tuple(m.RELEVANCE_RULES), intents=tuple(m.INTENTS),
            templates=tuple(m.TEMPLATES), boundaries=tuple(m.BOUNDARIES), backstops=tuple(m.BACKSTOPS),
            nonanswer_patterns=tuple(m.NONANSWER_PATTERNS), rewrite_meta_patterns=tuple(m.REWRITE_META_PATTERNS),
            known_generic=tuple(m.KNOWN_GENERIC), system_base=m.SYSTEM_BASE, route_prompts=dict(m.ROUTE_PROMPTS),
            rewrite_prompt=m.REWRITE_PROMPT, guidance=dict(m.GUIDANCE), guidance_header=m.GUIDANCE_HEADER,
            facts=tuple(m.FACTS), route_tokens=dict(m.ROUTE_TOKENS),
        )

    # -- rules as a table ---------------------------------------------------
    def rule_rows(self) -> list[tuple]:
        order: dict[tuple, int] = {}
        rows = []
        for i, (grp, on_text, category, pattern) in enumerate(self.rules):
            key = (grp, category)
            order.setdefault(key, len([k for k in order if k[0] == grp]))
            rows.append((self.name, grp, on_text, category, order[key], i, pattern))
        return rows

    def rules_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rule_rows(), RULE_SCHEMA)

    def with_rules(self, rules: DataFrame, max_rules: int = 5000) -> "Pack":
        """Replace the query rules with the rows of ``rules`` (RULE_SCHEMA columns).

        Rules become expressions of the plan, so a table of more than
        ``max_rules`` is taken for a mistake; pass another bound if it isn't.
        """
        n = rules.limit(max_rules + 1).count()
        if n > max_rules:
            raise ValueError(f"the rule table has more than {max_rules} rows")
        rows = rules.select("grp", "on_text", "category", "category_order", "rule_order", "pattern").collect()
        rows.sort(key=lambda r: (r.grp, r.category_order, r.rule_order))
        return replace(self, rules=tuple((r.grp, r.on_text, r.category, r.pattern) for r in rows))

    # -- the whole pack as tables --------------------------------------------
    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Every table of the pack by name: ``rules``, those of TABLES, and ``named`` for lists, prompts and limits."""
        out = {"rules": self.rules_table(spark)}
        for name, columns in TABLES.items():
            rows = [(i, *[list(v) if isinstance(v, (list, tuple)) else v for v in row]) for i, row in enumerate(getattr(self, name))]
            out[name] = spark.createDataFrame(rows, f"ord int, {columns}")
        named = [(n, None, v) for n in LISTS for v in getattr(self, n)]
        named += [(n, None, getattr(self, n)) for n in TEXTS]
        named += [(n, k, str(v)) for n in MAPS for k, v in getattr(self, n).items()]
        out["named"] = spark.createDataFrame([(i, *r) for i, r in enumerate(named)], f"ord int, {NAMED}")
        return out

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame], name: str = "tables", max_rows: int = 5000) -> "Pack":
        """A pack out of such tables; a missing table is empty, one of more than ``max_rows`` rows is an error.

        Rows come in the order of ``ord``; a null array is an empty one."""
        unknown = set(tables) - {"rules", "named", *TABLES}
        if unknown:
            raise ValueError(f"a pack has no table {', '.join(sorted(unknown))}")

        def rows(table: str, columns: str) -> list[tuple]:
            if table not in tables:
                return []
            fields = [c.split() for c in columns.split(", ")]
            found = tables[table].select("ord", *[f[0] for f in fields]).limit(max_rows + 1).collect()
            if len(found) > max_rows:
                raise ValueError(f"the table {table} has more than {max_rows} rows")
            found.sort(key=lambda r: r["ord"])
            return [tuple(tuple(v or ()) if kind.startswith("array") else v for v, (_, kind) in zip(r[1:], fields)) for r in found]

        named = rows("named", NAMED)
        of = lambda n: [(item, value) for x, item, value in named if x == n]
        pack = cls(
            name=name, **{t: tuple(rows(t, c)) for t, c in TABLES.items()}, **{n: tuple(v for _, v in of(n)) for n in LISTS},
            **{n: "".join(v for _, v in of(n)) for n in TEXTS}, **{n: dict(of(n)) for n in MAPS if n != "route_tokens"},
            route_tokens={k: int(v) for k, v in of("route_tokens")})
        return pack.with_rules(tables["rules"], max_rows) if "rules" in tables else pack

    def category_groups(self, grp: str, on_text: str) -> list[tuple[str, list[str]]]:
        """Ordered (category, patterns) for one rule group and text form."""
        out: dict[str, list[str]] = {}
        for g, t, category, pattern in self.rules:
            if g == grp and t == on_text:
                out.setdefault(category, []).append(pattern)
        return list(out.items())

    def patterns(self, grp: str, on_text: str) -> list[str]:
        return [p for g, t, _, p in self.rules if g == grp and t == on_text]

    def categories(self) -> list[str]:
        seen: list[str] = []
        for _, _, c, _ in self.rules:
            if c not in seen:
                seen.append(c)
        return seen
