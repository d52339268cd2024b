"""One query per operator, ``opN_<name>``: production parameters, whole tables, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe_codec import round_trip
from vellum.llm.hard_negatives import finite_integers, hard_negatives
from vellum.llm.jaccard_join import jaccard_classes
from vellum.llm.language_id import fit_language_model, identify_languages
from vellum.llm.near_dup_vectors import near_duplicate_vectors
from vellum.llm.packing import pack
from vellum.llm.quality_rules import BASE, POLICIES, ledger, mask, verdicts
from vellum.llm.run_detection import periodic_runs, strongest
from vellum.llm.sharding import shuffle_to_shards
from vellum.llm.substring_dedup import remove_repeated_windows
from vellum.llm.suffix_dedup import remove_repeated_bytes
from vellum.llm.token_counts import token_counts
from vellum.llm.topk_search import exact_top_k, quantized

SHARDS = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_near_dup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.col("text"), "UTF-8")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"))
    return shuffle_to_shards(rows, "doc_id", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = fit_language_model(docs.where(~F.col("held_out")))
    return identify_languages(docs, model, keep=("held_out",)).drop("languages")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return exact_top_k(vectors.where("id % 20 = 0"), vectors, 20)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = verdicts(ledger(read(spark, sf_dir, "documents")), POLICIES["web"])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed").bitwiseAND(mask(BASE)) != 0).alias("base_failed"), "kept", "failed")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = finite_integers(read(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", 256)
    return hard_negatives(rows, rows.where("id % 50 = 0"))


def op13_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(read(spark, sf_dir, "documents"), planted=True).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_near_dup_vectors, op2_jaccard_join, op3_token_counts, op4_suffix_dedup, op5_bpe_codec, op6_sharding,
    op7_substring_dedup, op8_packing, op9_language_id, op10_topk_search, op11_quality_rules, op12_hard_negatives,
    op13_run_detection)}

#: Words of a text in DuckDB.
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def jaccard_sql(words: int, percent: int, docs: str = "documents") -> str:
    """CTEs ``n`` (doc_id, n_shingles) and ``c`` (node, component_id) of the Jaccard join of ``docs``."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""w AS (SELECT doc_id, {WORDS_SQL.format(lower)} AS w FROM {docs}),
sh AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + {words} - 1], ' ') for i in range(1, len(w) - {words} + 2)]) END AS s
        FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM sh),
u AS (SELECT doc_id, unnest(s) AS x FROM sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
       WHERE 100 * k >= {percent} * (x.n_shingles + y.n_shingles - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)"""


def windows_sql(window: int, docs: str = "documents") -> str:
    """CTEs ``words`` (doc_id, w) and ``kept`` (doc_id, n_words, n_removed, kept) of substring deduplication."""
    return f"""words AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM {docs}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {window} - 1], ' ') AS x
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM words)),
low AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM win JOIN low USING (x) WHERE first < doc_id),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
                FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, coalesce(kept, '') AS kept
           FROM words LEFT JOIN left_over USING (doc_id))"""


ORACLE: dict[str, str] = {
    "op2_jaccard_join": f"WITH RECURSIVE {jaccard_sql(4, 85)} "
                        "SELECT doc_id, n_shingles, component_id FROM n JOIN c ON c.node = n.doc_id",
    "op4_suffix_dedup": """WITH
h AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM h)),
dup AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new
          FROM win SEMI JOIN dup USING (x)),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM isl GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
               string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM gap JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)""",
    "op7_substring_dedup": f"WITH {windows_sql(13)} SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept",
    "op1_near_dup_vectors": """WITH RECURSIVE
f AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS n FROM f
        WHERE v IS NOT NULL AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x for x in v if x <> 0]) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
       WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT c.node AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.node = component_id AS kept
  FROM c LEFT JOIN l ON l.a = c.node""",
    "op10_topk_search": """WITH
q AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
       WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_quality_rules": rf"""WITH
t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM win SEMI JOIN twice USING (doc_id, x))
         GROUP BY doc_id),
ln AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[!-/:-@\[-`{{-~]')) AS punct,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
        FROM ln LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (2 * word_chars < 5 * n_words)::BIGINT + 32 * (word_chars > 12 * n_words)::BIGINT
             + 64 * (100 * punct > 20 * word_chars)::BIGINT + 128 * (n_lines >= 3 AND 10 * bullets > 9 * n_lines)::BIGINT
             + 256 * (n_lines >= 3 AND 10 * ellipses > 3 * n_lines)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed,
       NOT (failed & 71 <> 0 OR bit_count(failed & 440) > 1) AS kept, failed FROM f""",
    "op12_hard_negatives": """WITH
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 3""",
}
