"""J5 build_messages (D1-D4) and D5 batch_generate.

Messages are ``array<struct<role, content>>`` built with native string and
array functions; prompt texts come from the pack.  Generation calls a user
function on Arrow batches inside ``mapInPandas`` (the model is not shipped).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.functions.text import col
from vellum.packs import Pack


def intent_guidance(categories, pack: Pack) -> Column:
    """Guidance of each category that has one, in the row's category order."""
    if not pack.guidance:
        return F.lit("")
    gmap = F.create_map(*[x for k, v in pack.guidance.items() for x in (F.lit(k), F.lit(v))])
    found = F.filter(F.transform(col(categories), lambda c: F.try_element_at(gmap, c)), lambda g: g.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit(pack.guidance_header), F.array_join(found, "\n- "))).otherwise("")


def verified_facts(categories, query, pack: Pack) -> Column:
    """Fact blocks: always / when categories present / when the query names a term."""
    parts = []
    for kind, trigger, text in pack.facts:
        if kind == "always":
            parts.append(F.lit(text))
        elif kind == "categories":
            cond = F.arrays_overlap(col(categories), F.array(*[F.lit(c) for c in trigger])).eqNullSafe(True)
            parts.append(F.when(cond, F.lit(text)).otherwise(""))
        else:
            low = F.lower(F.coalesce(col(query), F.lit("")))
            cond = F.lit(False)
            for term in trigger:
                cond = cond | low.contains(term.lower())
            parts.append(F.when(cond, F.lit(text)).otherwise(""))
    return F.concat(*parts) if parts else F.lit("")


def _route_prompt(route_name, pack: Pack) -> Column:
    chain = None
    for name, text in pack.route_prompts.items():
        chain = F.when(col(route_name) == name, F.lit(text)) if chain is None else chain.when(
            col(route_name) == name, F.lit(text))
    return chain.otherwise("") if chain is not None else F.lit("")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def generation_messages(query, route_name, categories, pack: Pack) -> Column:
    """D3: [system, user]; the user turn is the original (not normalized) query."""
    system = F.concat(F.lit(pack.system_base + "\n\n"), _route_prompt(route_name, pack),
                      intent_guidance(categories, pack), verified_facts(categories, query, pack))
    return F.array(message("system", system), message("user", F.coalesce(col(query), F.lit(""))))


def rewrite_messages(query, draft, route_name, categories, reason, pack: Pack,
                     note: str = "Keep what is correct; fix only what the reason names.") -> Column:
    """Rewrite request carrying the draft, route, categories and rejection reason."""
    cats = F.when(F.size(col(categories)) > 0, F.array_join(col(categories), ", ")).otherwise("general")
    system = F.concat(F.lit(pack.system_base + "\n\n" + pack.rewrite_prompt),
                      intent_guidance(categories, pack), verified_facts(categories, query, pack))
    user = F.concat(F.lit("Question:\n"), F.coalesce(col(query), F.lit("")),
                    F.lit("\n\nDraft:\n"), F.coalesce(col(draft), F.lit("")),
                    F.lit("\n\nRoute: "), col(route_name), F.lit("\nCategories: "), cats,
                    F.lit("\nReason: "), F.coalesce(col(reason), F.lit("")), F.lit("\nNote: " + note))
    return F.array(message("system", system), message("user", user))


GENERATION_FIELDS = [StructField("text", StringType()), StructField("finish_reason", StringType())]


def batch_generate(df: DataFrame, generate_fn: Callable[[list[list[dict]], list[int]], tuple[list[str], list[str]]] | None = None,
                   messages: str = "messages", max_tokens: str = "max_tokens", setup_fn: Callable[[], Callable] | None = None,
                   batch_size: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Call ``generate_fn(messages, max_tokens) -> (texts, finish_reasons)``, mixed token budgets in one call.

    One call for each Arrow batch, or for every ``batch_size`` rows of a task over the borders of
    Arrow batches (the last call of a task may have fewer).  ``setup_fn() -> generate_fn`` is
    called once in each worker process instead, where a model is loaded and stays.  A length
    mismatch is an error; reasons of the wrong length become ``unknown``.  ``keep``: the columns
    that come back with the answers; all, if not given."""
    if (generate_fn is None) == (setup_fn is None):
        raise ValueError("either a generator or its set-up")
    kept = df.columns if keep is None else keep
    df = df.select(*dict.fromkeys([*kept, messages, max_tokens]))  # no other column goes to Python
    schema = StructType([df.schema[c] for c in kept] + GENERATION_FIELDS)
    made: list = []  # a worker's own; it is pickled empty

    def answered(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(generate_fn or setup_fn())
        msgs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf[messages]]
        texts, reasons = made[0](msgs, [int(x) for x in pdf[max_tokens]])
        texts = list(texts)
        if len(texts) != len(pdf):
            raise ValueError("generator returned a different number of outputs")
        reasons = list(reasons) if reasons is not None and len(reasons) == len(pdf) else ["unknown"] * len(pdf)
        return pdf[kept].assign(text=texts, finish_reason=reasons)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            size = batch_size or len(held)
            while len(held) >= size:
                yield answered(held.iloc[:size])
                held = held.iloc[size:]
                if not len(held):
                    held = None
                    break
        if held is not None:
            yield answered(held)

    return df.mapInPandas(run, schema)
