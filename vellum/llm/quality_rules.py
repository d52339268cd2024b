"""Operator 11, quality rules as a ledger of failure bits.

Every text is measured once.  A rule compares whole-number measurements and owns
one bit; the ledger stores measurements and the bits of the rules that failed.
A policy is a versioned choice over those bits: which ones reject alone, and how
many of others together.  Verdicts, comparisons of policies and ablations (what
a policy would keep without one of its rules) are bitwise operations on the
ledger, and a table of bit patterns with their counts answers them for a corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks
from vellum.llm.words import M1, Words, mix

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_lines",
            "n_bullet_lines", "n_ellipsis_lines")
BLANKS = " \t\n\x0b\x0c\r"
BULLETS, ELLIPSES = ("-", "*", "•"), ("...", "…")


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


SYMBOL = table_of("#*$%&|<>")
PUNCTUATION = table_of("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
#: Bytes that begin a code point of a word.
LETTERS = np.array([int(not 0x80 <= b < 0xC0 and chr(b) not in BLANKS) for b in range(256)])


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text in windows that are found twice or more in it; equal windows by 64-bit hashes."""
    hashes, n = words.grams(window)
    if not len(hashes):
        return np.zeros(len(n), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    key = mix(hashes ^ (text.astype(np.uint64) * M1))  # texts never share a window
    by = np.argsort(key)
    equal = key[by[1:]] == key[by[:-1]]
    again = np.zeros(len(key), bool)
    again[by[1:]] |= equal
    again[by[:-1]] |= equal
    at = np.flatnonzero(again)
    place = words.first[text[at]] + at - (np.cumsum(n) - n)[text[at]]
    size = len(words.hashes) + 1
    cover = np.bincount(place, minlength=size) - np.bincount(place + window, minlength=size)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return covered[words.first[1:]] - covered[words.first[:-1]]


def line_counts(text: str) -> tuple[int, int, int, int]:
    """Lines with a word; of these, equal to an earlier line, with a bullet in front, ending in an ellipsis."""
    lines = [(x, s) for x in text.split("\n") if (s := x.strip(BLANKS))]
    return (len(lines), len(lines) - len({x for x, _ in lines}), sum(s.startswith(BULLETS) for _, s in lines),
            sum(s.endswith(ELLIPSES) for _, s in lines))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and MEASURES (long) of every row, each text read once and whole.

    Words are maximal runs other than blank and 0x09 to 0x0D.  Null, empty and
    blank texts have no words and no lines: all measurements are 0.  Repeated rows
    and rows with a null id are measured one by one; an empty table gives an empty
    result.  ``keep`` must not hold a name of MEASURES.
    """
    rest = {f"keep{i}": c for i, c in enumerate(c for c in keep if c != id_col)}  # names of the caller can't clash
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in rest.items()])

    def measure(batches):
        for b in chunks(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            words = Words(texts)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)) + 1
            edge = np.concatenate(([0], np.cumsum(size)))
            total = lambda of: np.diff(np.concatenate(([0], np.cumsum(of[words.data])))[edge])
            lines, copies, bullets, ellipses = np.array([line_counts(t) for t in texts], np.int64).reshape(-1, 4).T
            out = (words.counts(), total(LETTERS), total(SYMBOL), copies, repeated_words(words), total(PUNCTUATION),
                   lines, bullets, ellipses)
            yield pa.RecordBatch.from_arrays([b["id"], *[b[k] for k in rest], *map(pa.array, out)],
                                             names=["id", *rest, *MEASURES])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [f"{c} {kind[c]}" for c in ("id", *rest)] + [f"{m} long" for m in MEASURES]
    return rows.mapInArrow(measure, ", ".join(fields)).select(
        F.col("id").alias(id_col), *[F.col(k).alias(c) for k, c in rest.items()], *MEASURES)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` (over MEASURES, whole numbers only) holds.  ``bit`` is its place for good."""

    bit: int
    name: str
    fails: Callable[[], Column]


#: Thresholds as whole numbers.  A bit is never given to another rule; a changed rule gets a new bit and a new version.
RULES_VERSION = 1
RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "repeated_lines", lambda: (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
    Rule(4, "short_words", lambda: 2 * F.col("word_chars") < 5 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 12 * F.col("n_words")),
    Rule(6, "punctuation", lambda: 100 * F.col("n_punctuation") > 20 * F.col("word_chars")),
    Rule(7, "bullets", lambda: (F.col("n_lines") >= 3) & (10 * F.col("n_bullet_lines") > 9 * F.col("n_lines"))),
    Rule(8, "ellipses", lambda: (F.col("n_lines") >= 3) & (10 * F.col("n_ellipsis_lines") > 3 * F.col("n_lines"))),
)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """Rejects a text that fails a rule of ``any_of``, or more than ``allowed`` rules of ``several_of``."""

    name: str
    version: int
    any_of: tuple[str, ...]
    several_of: tuple[str, ...] = ()
    allowed: int = 0
    rules_version: int = RULES_VERSION

    def rejects(self, failed: Column) -> Column:
        out = failed.bitwiseAND(mask(self.any_of)) != 0
        if self.several_of:
            out = out | (F.bit_count(failed.bitwiseAND(mask(self.several_of))) > self.allowed)
        return out

    def without(self, rule: str) -> Policy:
        drop = lambda names: tuple(n for n in names if n != rule)
        return replace(self, any_of=drop(self.any_of), several_of=drop(self.several_of))


BASE = ("few_words", "repeated_words")
POLICIES = {p.name: p for p in (
    Policy("base", 1, BASE),
    Policy("strict", 1, tuple(r.name for r in RULES)),
    # one odd measurement is a matter of style, two are a sign of junk; symbols and punctuation speak for themselves
    Policy("web", 1, (*BASE, "symbols", "punctuation"),
           ("repeated_lines", "short_words", "long_words", "bullets", "ellipses"), 1),
)}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
           rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """Measurements of every row with ``failed`` (long, a bit for each failed rule) and ``rules_version``.

    The table to store: every later policy works on it without the texts.  See
    ``measured`` for odd rows; a text without words fails ``few_words`` alone.
    """
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("every rule has a bit of its own, 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, id_col, text_col, keep).withColumns({"failed": bits, "rules_version": F.lit(version)})


def verdicts(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``; a row written under other rules than the policy's is an error."""
    fits = F.col("rules_version") == policy.rules_version
    wrong = F.raise_error(F.lit(f"policy {policy.name} wants rules version {policy.rules_version}")).cast("boolean")
    return book.withColumn("kept", F.when(fits, ~policy.rejects(F.col("failed"))).otherwise(wrong))


def patterns(book: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``failed``, ``n``: rows of every bit pattern, 2^rules of them at most for each group."""
    return book.groupBy(*by, "failed").agg(F.count(F.lit(1)).alias("n"))


def policy_counts(book: DataFrame, policies: tuple[Policy, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``policy``, ``version``, ``n``, ``n_kept`` of every policy, all out of one table of patterns."""
    each = F.explode(F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"),
                                        (~p.rejects(F.col("failed"))).alias("kept")) for p in policies]))
    return (patterns(book, by).select(*by, "n", each.alias("p")).groupBy(*by, "p.policy", "p.version")
            .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p.kept"), F.col("n")).otherwise(0)).alias("n_kept")))


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of a policy does: ``by``, ``rule``, ``n``, ``n_failed``, ``n_alone``, ``n_kept_without``.

    ``n_failed``: rows that fail the rule; ``n_alone``: rejected rows that fail no
    other rule of the policy; ``n_kept_without``: rows that the policy keeps if
    it forgets the rule.  Rows are read once, as bit patterns.
    """
    own = mask((*policy.any_of, *policy.several_of), rules)
    failed = F.col("failed")
    each = []
    for r in sorted(rules, key=lambda r: r.bit):
        if own >> r.bit & 1:
            hit = failed.bitwiseAND(1 << r.bit) != 0
            alone = (failed.bitwiseAND(own) == 1 << r.bit) & policy.rejects(failed)
            each.append(F.struct(F.lit(r.name).alias("rule"), hit.alias("hit"), alone.alias("alone"),
                                 (~policy.without(r.name).rejects(failed)).alias("kept")))
    if not each:
        raise ValueError("the policy has no rules")
    count = lambda flag: F.sum(F.when(F.col(f"r.{flag}"), F.col("n")).otherwise(0))
    return (patterns(book, by).select(*by, "n", F.explode(F.array(*each)).alias("r")).groupBy(*by, "r.rule")
            .agg(F.sum("n").alias("n"), count("hit").alias("n_failed"), count("alone").alias("n_alone"),
                 count("kept").alias("n_kept_without")))


def profile(book: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n``, ``any_failed`` (bits that some row failed), ``all_failed`` (bits that every row failed)."""
    return book.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_or("failed").alias("any_failed"),
                                 F.bit_and("failed").alias("all_failed"))
