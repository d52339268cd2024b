"""Operator 9, language identification by multilingual mixture inference.

Training counts the character n-grams of each language's labelled texts.  A
document is a bag of words drawn from a mixture of languages: expectation-
maximisation estimates its language proportions from the words' n-gram
likelihoods, and languages leave the mixture, weakest first, as long as the
penalised likelihood (BIC) rises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import chunks, ragged

#: n-gram buckets of the model; its size is languages x BUCKETS.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: About so many texts of each language are fitted on (all, if it has fewer), chosen by a hash of the id.
FIT_TEXTS = 3000
#: Most languages that a model may have.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Longer runs of letters are read in pieces of so many letters.
WORD_LETTERS = 64


def letter_runs():
    """``findall`` of maximal runs of letters (general category L), cut every WORD_LETTERS letters."""
    return regex.compile(r"\p{L}{1,%d}" % WORD_LETTERS).findall


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``" word "`` for every word, one word after another; n-grams per word."""
    flat = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(n + 1) - (n + 1)  # of the blank before a word
    mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out, per = [], []
    value = np.zeros(len(flat), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        value = (value[: len(flat) - order + 1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[order - 1:])
        if order not in ORDERS:
            continue
        bucket = ((value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) & np.uint64(BUCKETS - 1)
        first = starts + (order == 1)
        count = np.maximum(n + 2 - 2 * (order == 1) - order + 1, 0)
        out.append((first, count, bucket))
        per.append(count)
    total = np.sum(per, axis=0)
    begin = np.cumsum(total) - total
    grams = np.zeros(int(total.sum()), np.int64)
    for (first, count, bucket), before in zip(out, np.cumsum([np.zeros_like(total), *per], axis=0)):
        grams[ragged(begin + before, count)] = bucket[ragged(first, count)]
    return grams, total


class Model:
    """Log-likelihoods of n-gram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.log = np.log(share).T.astype(np.float32)  # buckets x languages

    def words(self, words: list[str]) -> np.ndarray:
        """Mean log-likelihood per n-gram, times the letters: words x languages."""
        grams, n = gram_buckets(words)
        starts = np.cumsum(n) - n
        return np.add.reduceat(self.log[grams], starts, axis=0) / len(ORDERS)


def mixtures(like: np.ndarray, weight: np.ndarray, starts: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Language proportions of documents (documents x languages, 0 outside the chosen set).

    ``like``: words x languages, log-likelihoods; ``weight``: how often a word
    stands in its document; ``starts``: first word of each document.  A round
    takes out the weakest language and those that hold less than one word; a
    language alone needs no EM.
    """
    docs, k = len(starts), like.shape[1]
    n = np.diff(np.append(starts, len(weight)))
    total = np.add.reduceat(weight, starts)
    alone = np.add.reduceat(like * weight[:, None], starts, axis=0)
    peak = like.max(axis=1)
    base = np.add.reduceat(peak * weight, starts)
    p = np.exp(like - peak[:, None])

    def fit(pi, of, weight, p, starts, total):
        for _ in range(rounds):
            joint = p * pi[of]
            joint *= (weight / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
            pi = np.add.reduceat(joint, starts, axis=0) / total[:, None]
        mass = np.maximum((p * pi[of]).sum(axis=1), 1e-30)
        return pi, np.add.reduceat(np.log(mass) * weight, starts)

    active = np.ones((docs, k), bool)
    pi, score = fit(np.full((docs, k), 1 / k, like.dtype), np.repeat(np.arange(docs), n), weight, p, starts, total)
    score += base - 0.5 * (k - 1) * np.log(total + 1)
    at = np.flatnonzero(active.sum(axis=1) > 1)
    while len(at):
        share = np.where(active[at], pi[at], np.inf)
        less = active[at] & (share * total[at, None] >= 1)
        less[np.arange(len(at)), share.argmin(axis=1)] = False
        best = pi[at].argmax(axis=1)
        less[np.arange(len(at)), best] = True
        size = less.sum(axis=1)
        new = np.where(less, pi[at], 0)
        new = (new / new.sum(axis=1, keepdims=True)).astype(like.dtype)
        value = alone[at, best].astype(np.float64)
        some = np.flatnonzero(size > 1)
        if len(some):
            rows, m = at[some], n[at[some]]
            words = ragged(starts[rows], m)
            new[some], found = fit(new[some], np.repeat(np.arange(len(some)), m), weight[words], p[words],
                                   np.cumsum(m) - m, total[rows])
            value[some] = found + base[rows]
        value -= 0.5 * (size - 1) * np.log(total[at] + 1)
        better = value >= score[at]
        won = at[better]
        active[won], pi[won], score[won] = less[better], new[better], value[better]
        at = won[size[better] > 1]
    return np.where(active, pi, 0)


class Reader:
    """Bags of words of whole texts."""

    def __init__(self):
        self.runs = letter_runs()

    def bags(self, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, then per document its words (as places), how often, and how many."""
        place: dict[str, int] = {}
        at, often, n = [], [], []
        for text in texts:
            bag = Counter(self.runs((text or "").lower()))
            at += [place.setdefault(w, len(place)) for w in bag]
            often += bag.values()
            n.append(len(bag))
        return list(place), np.array(at, np.int64), np.array(often, np.float32), np.array(n, np.int64)


def fit_language_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                       fit_texts: int = FIT_TEXTS) -> Model:
    """Count n-grams per language over a bounded sample of the labelled rows of ``docs``.

    The bound is ``fit_texts`` texts of a language on average; rows are chosen
    by a hash of their id, whole texts are counted.  What reaches the driver is
    languages x BUCKETS counts.  Rows with a null text or label don't count.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("draw"), F.col(text_col).alias("text"))
    found = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, fit_texts / r["count"])))])
    sample = rows.where(F.pmod(F.col("draw"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        reader, sums = Reader(), {}
        for b in chunks(batches):
            lang = np.array(b["lang"].to_pylist())
            for name in np.unique(lang):
                words, at, often, _ = reader.bags(b["text"].filter(pa.array(lang == name)).to_pylist())
                if words:
                    grams, n = gram_buckets(words)
                    weight = np.repeat(np.bincount(at, often, len(words)), n)
                    sums[name] = sums.get(name, 0) + np.bincount(grams, weight, BUCKETS)
        for name, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some)), pa.array(some), pa.array(c[some])],
                                             names=["lang", "bucket", "n"])

    counted = (sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n double")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in counted["lang"]], counted["bucket"].to_numpy(np.int64)] = counted["n"]
    return Model(languages, counts)


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicted language of every whole text: ``id_col``, ``keep`` columns, ``lang_pred``, ``score``, ``languages``.

    ``lang_pred`` is the language with the largest share (ties: first in the
    order of names), ``score`` that share, ``languages`` the chosen set from
    the largest share down.  A text that is null or has no letter is ``und``
    with score 0 and an empty set; so is every text if the model learned no
    language.  Null ids are kept, repeated rows are judged each, and an empty
    table gives an empty result.  Row-local; a very long text is one bag.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("keep"),
                       F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats, MAX_LANGUAGES at most

    def run(batches):
        model, reader = shared.value, Reader()
        names = np.array(model.languages, object)
        for b in chunks(batches):
            words, at, often, n = reader.bags(b["text"].to_pylist())
            pred, score, sets = [UNKNOWN] * len(n), np.zeros(len(n)), [[] for _ in n]
            some = np.flatnonzero(n)
            if len(some) and len(names):
                m = n[some]
                pi = mixtures(model.words(words)[at], often, np.cumsum(m) - m)
                best = pi.argmax(axis=1)
                for i, j, row in zip(some, best, pi):
                    pred[i], score[i] = names[j], min(1.0, float(row[j]))
                    sets[i] = [names[x] for x in np.argsort(-row, kind="stable") if row[x] > 0]
            yield pa.RecordBatch.from_arrays(
                [b["id"], b["keep"], pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))],
                names=["id", "keep", "lang_pred", "score", "languages"])

    schema = T.StructType([rows.schema["id"], rows.schema["keep"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), *[F.col(f"keep.{c}").alias(c) for c in keep],
                                               "lang_pred", "score", "languages")
