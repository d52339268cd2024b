"""Pair-guard arithmetic as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vellum.functions.regex import SPACE_JAVA
from vellum.functions.text import col, unicode_strip


def _c(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else col(x)


def pair_budget(qlen, rlen, budget, reserve) -> tuple[Column, Column]:
    """Split ``budget`` tokens between query and response.

    The response gets up to ``reserve`` first; the query takes what it needs of
    the rest; leftover goes to the response, then to the query.
    """
    if any(isinstance(x, (int, float)) and x < 0 for x in (budget, reserve)):
        raise ValueError("a token budget is not negative")
    q, r, b, res = _c(qlen), _c(rlen), _c(budget), _c(reserve)
    r0 = F.least(r, res, b)
    q0 = F.least(q, b - r0)
    rem = b - r0 - q0
    rx = F.least(F.greatest(F.lit(0), r - r0), rem)
    r1 = r0 + rx
    q1 = q0 + F.least(F.greatest(F.lit(0), q - q0), rem - rx)
    return q1, r1


def head_tail(arr, limit) -> Column:
    """Keep the head and a quarter-sized tail of an array within ``limit``."""
    a, lim = col(arr), _c(limit)
    tail = F.greatest(F.lit(1), F.floor(lim / 4).cast("int"))
    return (F.when(lim <= 0, F.slice(a, 1, 0))
             .when(F.size(a) <= lim, a)
             .when(lim == 1, F.slice(a, 1, 1))
             .otherwise(F.concat(F.slice(a, F.lit(1), lim - tail), F.slice(a, -tail, tail))))


def ends_of(tokens: Column, keep: int) -> Column:
    """struct<n, head, tail> of an array of tokens: how many, the first and the last ``keep``."""
    return F.struct(F.size(tokens).alias("n"), F.slice(tokens, 1, keep).alias("head"),
                    F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - keep + 1), keep).alias("tail"))


def whitespace_ends(text: Column, keep: int) -> Column:
    """``ends_of`` the whitespace tokens of a text, of which only 2 * ``keep`` are ever taken out."""
    t = F.coalesce(text, F.lit(""))

    def first(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, f"^[{SPACE_JAVA}]+", ""), f"[{SPACE_JAVA}]+", keep + 1)
        return F.slice(F.filter(parts, lambda p: p != ""), 1, keep)

    n = F.length(F.regexp_replace(unicode_strip(t), f"[{SPACE_JAVA}]*[^{SPACE_JAVA}]+", "x"))
    return F.struct(n.alias("n"), first(t).alias("head"),
                    F.reverse(F.transform(first(F.reverse(t)), F.reverse)).alias("tail"))


#: Characters of a text that a tokenizer gets at once.
PIECE_CHARS = 1 << 18


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``chars``, cut before a blank between two letters.

    No pre-token of a byte-level vocabulary goes on from a letter over a blank, so the
    pieces have the tokens of the whole.  Without such a place the piece is longer."""
    at = 0
    cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
    while len(text) - at > chars:
        found = cut.search(text, at + chars)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def tokenizer_ends(setup_fn: Callable[[], Callable[[str], list]], piece_chars: int = PIECE_CHARS) -> Callable[[Column, int], Column]:
    """``ends`` for a user's tokenizer: ``setup_fn() -> encode``, called once in a worker; ``encode(text) -> ids``.

    A long text is encoded piece by piece and only its count and ends are kept, so a task
    holds the tokens of one piece.  Ids are given as decimal strings."""
    made: list = []

    def ends(text: Column, keep: int) -> Column:
        @pandas_udf("struct<n:int,head:array<string>,tail:array<string>>")
        def counted(texts: pd.Series) -> pd.DataFrame:
            if not made:
                made.append(setup_fn())
            rows = []
            for t in texts:
                n, head, tail = 0, [], []
                for piece in pieces(t or "", piece_chars):
                    ids = made[0](piece)
                    n += len(ids)
                    head += ids[:keep - len(head)]
                    tail = (tail + list(ids[-keep:]))[-keep:]
                rows.append((n, [str(i) for i in head], [str(i) for i in tail]))
            return pd.DataFrame(rows, columns=["n", "head", "tail"])
        return counted(text)
    return ends


def tokenizer_file(path: str) -> Callable[[], Callable[[str], list]]:
    """``setup_fn`` for a tokenizer file that every worker can read: ids without added special tokens."""
    def setup():
        from tokenizers import Tokenizer
        made = Tokenizer.from_file(path)
        return lambda text: made.encode(text, add_special_tokens=False).ids
    return setup


def visible_ends(ends: Column, limit) -> Column:
    """E2 from ``ends_of`` a token list that keeps at least ``limit``: head and a quarter-sized tail within it."""
    n, lim = ends["n"], _c(limit)
    tail = F.greatest(F.lit(1), F.floor(lim / 4).cast("int"))
    return (F.when(lim <= 0, F.slice(ends["head"], 1, 0))
             .when(n <= lim, ends["head"])
             .when(lim == 1, F.slice(ends["head"], 1, 1))
             .otherwise(F.concat(F.slice(ends["head"], F.lit(1), lim - tail), F.slice(ends["tail"], -tail, tail))))


def serialize_pair(visible_query, visible_response, prefix: str = "input: ", separator: str = " output: ") -> Column:
    """Classifier input text from the visible token windows."""
    return F.concat(F.lit(prefix), F.array_join(col(visible_query), " "), F.lit(separator),
                    F.array_join(col(visible_response), " "))


def softmax(logits) -> Column:
    """Numerically stable softmax of a logits array."""
    a = col(logits)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def harm_index(id2label: dict[int, str]) -> int | None:
    """E6 label lookup (resolved once, on the driver): the first label naming harm."""
    for i, name in id2label.items():
        name = str(name).lower()
        if "harm" in name or "unsafe" in name:
            return int(i)
    return None


def harm_probability(probs, id2label: dict[int, str]) -> Column:
    """Probability of the harmful class; single value -> itself; else the last.

    A harmful index past the end of the array gives null (the reference raises)."""
    p = col(probs)
    idx = harm_index(id2label)
    pick = (F.try_element_at(p, F.lit(idx + 1)) if idx is not None
            else F.when(F.size(p) == 1, F.try_element_at(p, F.lit(1))).otherwise(F.try_element_at(p, F.lit(-1))))
    return F.when(F.size(p) == 0, F.lit(0.0)).otherwise(pick)


def label(prob, threshold: float = 0.5) -> Column:
    """Harmful when p >= threshold."""
    return F.when(col(prob) >= threshold, "harmful").otherwise("safe")
