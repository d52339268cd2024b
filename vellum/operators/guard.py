"""J6 guard_pairs: classifier input windows, visibility (E3), and scoring (E5).

Scoring has two forms: join a precomputed assessment table, or call a user
function on Arrow batches inside ``mapInPandas`` (row-local, no shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vellum.functions.guard import ends_of, pair_budget, serialize_pair, visible_ends, whitespace_ends
from vellum.functions.text import col

VISIBILITY_FIELDS = ["guard_query_total_tokens", "guard_query_visible_tokens", "guard_response_total_tokens",
                     "guard_response_token_budget", "estimated_visible_tokens"]


def content_budget(max_length: int = 128, special_tokens: int = 2, prefix_tokens: int = 1,
                   separator_tokens: int = 1) -> int:
    budget = max_length - special_tokens - prefix_tokens - separator_tokens
    if budget < 1:
        raise ValueError("max_length is too small for the serialization markers")
    return budget


def pair_visibility(query_tokens, response_tokens, max_length: int = 128, reserve: int = 64,
                    special_tokens: int = 2, prefix_tokens: int = 1, separator_tokens: int = 1) -> Column:
    """Struct of the five visibility counts plus the serialized input, from arrays of all tokens."""
    budget = content_budget(max_length, special_tokens, prefix_tokens, separator_tokens)
    return ends_visibility(ends_of(col(query_tokens), budget), ends_of(col(response_tokens), budget), budget, reserve)


def ends_visibility(query: Column, response: Column, budget: int, reserve: int) -> Column:
    """E3 from the ends of two token lists (``ends_of``, ``whitespace_ends``, ``tokenizer_ends``), kept to ``budget``."""
    def counts(pair: Column) -> Column:
        q, r = pair["q"], pair["r"]
        qb, rb = pair_budget(q["n"], r["n"], budget, reserve)
        vq, vr = visible_ends(q, qb), visible_ends(r, rb)
        return F.struct(
            q["n"].alias("guard_query_total_tokens"),
            F.size(vq).alias("guard_query_visible_tokens"),
            r["n"].alias("guard_response_total_tokens"),
            rb.cast("int").alias("guard_response_token_budget"),
            F.size(vr).alias("estimated_visible_tokens"),
            serialize_pair(vq, vr).alias("guard_input"),
        )

    # as a lambda's variable the ends are made once, however often the arithmetic names them
    return F.get(F.transform(F.array(F.struct(query.alias("q"), response.alias("r"))), counts), F.lit(0))


@dataclass(frozen=True)
class Window:
    """What a classifier sees of a pair: its length, the response's reserve, markers, and how texts become tokens.

    ``ends(text, keep)`` gives the number of tokens with the first and the last ``keep`` of them;
    a text of any length so never becomes an array of all its tokens."""

    max_length: int = 128
    reserve: int = 64
    special_tokens: int = 2
    prefix_tokens: int = 1
    separator_tokens: int = 1
    ends: Callable[[Column, int], Column] = whitespace_ends

    def seen(self, query, response) -> Column:
        """E3 for two texts."""
        budget = content_budget(self.max_length, self.special_tokens, self.prefix_tokens, self.separator_tokens)
        return ends_visibility(self.ends(col(query), budget), self.ends(col(response), budget), budget, self.reserve)

    def numbers(self) -> tuple:
        return self.max_length, self.reserve, self.special_tokens, self.prefix_tokens, self.separator_tokens


def guard_pairs(df: DataFrame, query: str, response: str, max_length: int = 128, reserve: int = 64,
                ends: Callable[[Column, int], Column] = whitespace_ends) -> DataFrame:
    """J6 (input side): add ``visibility`` computed from the ends of the tokenized query and response."""
    return df.withColumn("visibility", Window(max_length, reserve, ends=ends).seen(query, response))


ASSESSMENT_FIELDS = [StructField("label", StringType()), StructField("harmful_probability", DoubleType()),
                     StructField("raw_error", StringType())]


def _scored(classify_fn, rows: list[tuple[str, str]], threshold: float) -> list[tuple[str, float, str | None]]:
    probs = list(classify_fn([q or "" for q, _ in rows], [r or "" for _, r in rows]))
    if len(probs) != len(rows):
        raise ValueError("classifier returned a different number of scores")
    return [("harmful" if float(p) >= threshold else "safe", float(p), None) for p in probs]


def _isolated(classify_fn, rows: list[tuple[str, str]], threshold: float, retry_rows: bool) -> list[tuple[str, float, str | None]]:
    """The scores of one chunk; if it fails, it is unknown as a whole, or each row is asked for alone."""
    try:
        return _scored(classify_fn, rows, threshold)
    except Exception as exc:  # noqa: BLE001 - isolation is the point
        if retry_rows and len(rows) > 1:
            return [x for row in rows for x in _isolated(classify_fn, [row], threshold, False)]
        return [("unknown", 1.0, str(exc))] * len(rows)


def batch_classify(df: DataFrame, classify_fn: Callable[[list[str], list[str]], list[float]],
                   query: str = "query", response: str = "response", batch_size: int = 16,
                   threshold: float = 0.5, retry_rows: bool = False) -> DataFrame:
    """E5: score (query, response) pairs with a user function on Arrow batches.

    ``classify_fn(queries, responses) -> harmful probabilities`` is called per
    chunk of ``batch_size`` rows inside ``mapInPandas``, so scoring runs where the
    data is.  A chunk that raises is marked ``unknown`` with p = 1.0 and the
    error text (the reference's isolation unit); with ``retry_rows`` each row of
    a failed chunk is retried alone so one bad row does not sink its neighbours.
    ``classify_by_budget`` fills batches by their tokens and across Arrow batches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf[query].tolist(), pdf[response].tolist()))
            yield _with_results(pdf, [x for s in range(0, len(pairs), batch_size) for x in _isolated(
                classify_fn, pairs[s:s + batch_size], threshold, retry_rows)])

    return df.mapInPandas(run, StructType(list(df.schema.fields) + ASSESSMENT_FIELDS))


def _with_results(pdf: pd.DataFrame, results: list[tuple[str, float, str | None]]) -> pd.DataFrame:
    out = pdf.copy()
    out["label"], out["harmful_probability"], out["raw_error"] = map(list, zip(*results)) if results else ([], [], [])
    return out


def budget_batches(lengths: list[int], budget: int, max_rows: int) -> list[list[int]]:
    """Places in batches of similar length: a batch, padded to its longest member, has at most ``budget``
    tokens and ``max_rows`` rows; a longer text is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < max_rows and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def padding(lengths: list[int], batches: list[list[int]]) -> tuple[int, int]:
    """Tokens of the texts, and of the batches with every text padded to the longest beside it."""
    return sum(lengths), sum(len(b) * max(lengths[i] for i in b) for b in batches)


def classify_by_budget(df: DataFrame, setup_fn: Callable[[], Callable[[list[str], list[str]], list[float]]],
                       query: str = "query", response: str = "response", budget: int = 8192, max_rows: int = 256,
                       length_fn: Callable[[str, str], int] | None = None, most_tokens: int | None = None,
                       horizon: int = 4096, horizon_chars: int = 64 << 20, threshold: float = 0.5,
                       retry_rows: bool = False) -> DataFrame:
    """E5 with batches filled by tokens: the rows of ``batch_classify`` in their order, scored in batches of similar length.

    ``setup_fn() -> classify_fn`` is called once in each worker process, where a model is loaded
    into memory and stays.  Rows are gathered over the borders of Arrow batches until there are
    ``horizon`` of them, or ``horizon_chars`` characters (what a task holds), sorted by length and
    cut into batches that have at most ``budget`` tokens when padded and ``max_rows`` rows.
    ``length_fn(query, response)`` counts the tokens of a pair (default: its words), at most
    ``most_tokens`` (a model's limit).  The order of the rows is restored.  A batch that fails is
    ``unknown``, as there.
    """
    count = length_fn or (lambda q, r: len(q.split()) + len(r.split()))
    model: list = []  # a worker's own; it is pickled empty

    def scored(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for pdf in held for p in zip(pdf[query].tolist(), pdf[response].tolist())]
        lengths = [max(1, count(q or "", r or "")) for q, r in pairs]
        lengths = [min(n, most_tokens) for n in lengths] if most_tokens else lengths
        results: list = [None] * len(pairs)
        for batch in budget_batches(lengths, budget, max_rows):
            for i, x in zip(batch, _isolated(model[0], [pairs[i] for i in batch], threshold, retry_rows)):
                results[i] = x
        at = 0
        for pdf in held:
            yield _with_results(pdf, results[at:at + len(pdf)])
            at += len(pdf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not model:
            model.append(setup_fn())
        held, rows, chars = [], 0, 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            chars += int(pdf[query].str.len().sum() + pdf[response].str.len().sum())
            if rows >= horizon or chars >= horizon_chars:
                yield from scored(held)
                held, rows, chars = [], 0, 0
        if held:
            yield from scored(held)

    return df.mapInPandas(run, StructType(list(df.schema.fields) + ASSESSMENT_FIELDS))


def join_assessments(df: DataFrame, assessments: DataFrame, key: str = "original_index") -> DataFrame:
    """E5 table form: left join precomputed scores; a missing score is ``unknown``, p = 1.0, and a
    second one for the same key fails the job."""
    per = assessments.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("label", "harmful_probability")).alias("_a"))
    twice = F.raise_error(F.concat(F.lit("more than one assessment for "), F.col(key).cast("string")))
    a = per.select(key, F.when(F.col("_n") > 1, twice.cast("string")).otherwise(F.lower("_a.label")).alias("_label"),
                   F.col("_a.harmful_probability").cast("double").alias("_p"))
    return (df.join(a, key, "left")
              .withColumn("label", F.coalesce(F.col("_label"), F.lit("unknown")))
              .withColumn("harmful_probability", F.coalesce(F.col("_p"), F.lit(1.0)))
              .drop("_label", "_p"))
