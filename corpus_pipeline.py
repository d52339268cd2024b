"""Corpus pipeline: language identification, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and all but the last return the columns of ``documents``.  Between stages the
rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import staged
from vellum.llm.jaccard_join import jaccard_classes
from vellum.llm.language_id import UNKNOWN, fit_language_model, identify_languages
from vellum.llm.packing import pack
from vellum.llm.queries import held_out, read
from vellum.llm.substring_dedup import remove_repeated_windows

#: Near duplicates: words of a shingle, percent of the union that must be shared.
SHINGLE_WORDS, SHARED_PERCENT = 5, 80
WINDOW_WORDS = 13


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language: those with a letter in their text.

    Null, empty and letterless texts go.  The model learns from the labelled
    documents that are not held out; without any label nothing can be told
    apart, and every text with a letter stays.  Repeated rows are judged one by
    one, rows with a null id too (they are never held out); a text of any length
    is read whole; an empty table gives an empty one.
    """
    model = fit_language_model(docs.where(~F.coalesce(held_out(), F.lit(False))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return identify_languages(docs, model, keep=rest).where(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every class of near duplicates.

    Rows with a null id link with nothing and stay; rows that repeat an id and a
    text are one document and stay or go together.  Null and empty texts have no
    shingles, link with nothing and stay; an empty table gives an empty one.
    """
    classes = jaccard_classes(docs, SHINGLE_WORDS, SHARED_PERCENT)
    gone = classes.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words of passages that a smaller document has; texts that keep all words stay as they are.

    ``n_chars`` follows the text.  A document that loses all its words goes.  A row
    with a null id is neither judged nor held against others; rows that repeat an id
    and a text are one document and lose the same words; null and empty texts stay as
    they are; an empty table gives an empty one.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeated_windows(docs, WINDOW_WORDS, keep=rest).where("n_removed = 0 or n_removed < n_words")
    less = F.col("n_removed") > 0
    out = cut.withColumn("text", F.when(less, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(less, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 1024 tokens.

    A null or empty text is the closing id alone.  Repeated rows and rows with a null
    id are packed one by one; a long text is cut into as many pieces as it takes; an
    empty table gives no piece.
    """
    return pack(docs)


STAGES = [
    ("language_id", identify),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_tokens),
]

#: Language identification and tokens can't be expressed in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
