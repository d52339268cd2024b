import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     T.StructField("id", T.StringType()), T.StructField("part", T.LongType()),
                     T.StructField("ids", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("block", T.StringType()), T.StructField("_block", T.StringType()),
                     T.StructField("a", T.StringType()), T.StructField("shard", T.StringType())])


def documents(spark, rows, partitions=3):
    """``rows``: (doc_id, text[, lang]); the other columns are filled with clashing names and nulls."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]),
             "x", 1, "y", None, "z", "b", "a", "s") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, exact copies, special strings, long runs, a very long text."""
    r = random.Random(7)
    words = ["alpha", "be", "Über", "naïve", "漢字", "it's", "we'll", "x1", "--", "😀", "co-op", "\x00", "the", "of"]
    body = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 12, 13, 40, 300, 900)]
    long = " ".join(r.choice(words) + str(r.randrange(1000)) for _ in range(120_000))
    texts = [None, "", " ", "\n\t ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "a" * 5000, " " * 3000 + "x",
             "ab" * 2000, *body, body[4] + " tail", "head " + body[5], body[5], long]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, body[4]), (None, None), (10_000, body[4]), (10_001, body[4])]
    return rows
