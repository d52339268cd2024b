"""Parquet table sources (the driver's tables) and derived views.

Reads name only the columns a job needs, so Catalyst prunes the Parquet scan
(``ReadSchema``) and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}
#: Session setting: so many tasks for each scan of a text table.  Unset, scans keep their splits.
SCAN_PARTITIONS = "spark.vellum.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns.  A file of one row group is one split, whatever its size; a caller who has
    such files asks for more tasks by SCAN_PARTITIONS, which costs a shuffle of the scanned columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    tasks = spark.conf.get(SCAN_PARTITIONS, None) if name in TEXT_TABLES else None
    return df.repartition(int(tasks)) if tasks else df


#: Turns of one conversation that a task takes at once.
TURN_BLOCK = 4096


def next_turns(conv: DataFrame, offsets: tuple[int, ...], columns: tuple[str, ...], block: int = TURN_BLOCK) -> DataFrame:
    """Add ``<column>_<k>``: the column's value k turns later in the conversation, for each offset k.

    A conversation of any length is cut into blocks of turn numbers.  ``lead``
    works within a block; for its last turns the first turns of the blocks that
    follow are carried over, a few rows for each block.
    """
    reach = max(offsets)
    x = conv.withColumn("_block", F.floor(F.col("turn") / block))
    w = Window.partitionBy("conv_id", "_block").orderBy("turn")
    x = x.withColumns({**{f"{c}_{k}": F.lead(c, k).over(w) for k in offsets for c in columns},
                       "_at": F.row_number().over(w),
                       "_left": F.count(F.lit(1)).over(Window.partitionBy("conv_id", "_block"))})
    heads = (x.where(F.col("_at") <= reach).groupBy("conv_id", "_block")
             .agg(F.sort_array(F.collect_list(F.struct("_at", *columns))).alias("_head")))
    after = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(1, reach)
    carried = heads.select("conv_id", "_block", F.flatten(F.collect_list("_head").over(after)).alias("_next"))
    x = x.withColumn("_left", F.col("_left") - F.col("_at")).join(carried, ["conv_id", "_block"], "left")
    over = {k: F.try_element_at("_next", (F.lit(k) - F.col("_left")).cast("int")) for k in offsets}
    return x.withColumns({f"{c}_{k}": F.when(F.col("_left") >= k, F.col(f"{c}_{k}")).otherwise(over[k][c])
                          for k in offsets for c in columns}).drop("_block", "_at", "_left", "_next")


#: Turn numbers lie below this, so (conv_id, turn) fits one long without collisions.
TURNS = 1 << 32


def pair_index(conv_id, turn) -> Column:
    """One long for (conv_id, turn)."""
    c, t = F.col(conv_id), F.col(turn)
    return F.when((t >= 0) & (t < TURNS), c * TURNS + t).otherwise(
        F.raise_error(F.lit("a turn number is negative or 2^32 and more")).cast("long"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it.

    Returns ``original_index`` (one long for (conv_id, turn)), ``id``, the two
    keys, ``query``, ``response`` and ``rewrite``, the assistant turn after that.
    """
    return pairs_of(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def pairs_of(conv: DataFrame, block: int = TURN_BLOCK) -> DataFrame:
    nxt = next_turns(conv, (1, 3), ("role", "text"), block)
    pairs = nxt.filter((F.col("role") == "user") & (F.col("role_1") == "assistant"))
    return pairs.select(
        pair_index("conv_id", "turn").alias("original_index"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn",
        F.col("text").alias("query"),
        F.col("text_1").alias("response"),
        F.when(F.col("role_3") == "assistant", F.col("text_3")).alias("rewrite"),
    )


PAIRS_SQL = """(SELECT conv_id * 4294967296 + turn AS original_index,
        'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
        conv_id, turn, text AS query, next_text AS response,
        CASE WHEN later_role = 'assistant' THEN later_text END AS rewrite
   FROM (SELECT conv_id, turn, role, text,
                lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
                lead(role, 3) OVER (PARTITION BY conv_id ORDER BY turn) AS later_role,
                lead(text, 3) OVER (PARTITION BY conv_id ORDER BY turn) AS later_text
           FROM conversations) c
  WHERE role = 'user' AND next_role = 'assistant')"""


def mutated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs with deterministic edits that exercise the quality checks.

    Every pair is kept; ``conv_id % 4`` edits the query (acronyms, a math task,
    a format task) and ``conv_id % 9`` edits the response (role prefix,
    reasoning block, dangling endings, Han characters, a fence, a canned
    refusal, names and a truncated URL).  ``finish_reason`` cycles with turn.
    """
    p = conversation_pairs(spark, sf_dir)
    k4, k9, q, r = F.col("conv_id") % 4, F.col("conv_id") % 9, F.col("query"), F.col("response")
    lit = F.lit
    query = (F.when(k4 == 1, F.concat(lit("ACME GPU: "), q))
              .when(k4 == 2, F.concat(q, lit(" How many items cost 12 and 5 in total?")))
              .when(k4 == 3, F.concat(lit("Write exactly 3 bullet points in JSON: "), q))
              .otherwise(q))
    resp = (F.when(k9 == 0, F.concat(lit("Assistant: "), r))
             .when(k9 == 1, F.concat(lit("<think>draft plan</think>"), r, lit(" (see")))
             .when(k9 == 2, F.concat(r, lit("\n2.")))
             .when(k9 == 3, F.concat(r, lit(" and")))
             .when(k9 == 4, F.concat(r, lit(" \u6f22\u5b57 ACME.")))
             .when(k9 == 5, F.concat(lit("```text\n"), r, lit("\n```")))
             .when(k9 == 6, F.concat(r, lit("\n\n\n\nSummary:")))
             .when(k9 == 7, F.concat(lit("None of the passages at hand settles this; name one "
                                         "document or section to look at. "), r))
             .otherwise(F.concat(r, lit(" Reported by Jane Smith at WHO [1] www.example"))))
    k5, k7 = F.col("conv_id") % 5, F.col("conv_id") % 7
    resp = F.when(k5 == 2, F.concat(lit("Revision note: wording kept as submitted. "), resp)).otherwise(resp)
    resp = (F.when(k7 == 3, F.concat(resp, lit(' token = "0123456789abcdef0123"')))
             .when(k7 == 5, F.concat(resp, lit(" Mail 12@mail1.example.com."))).otherwise(resp))
    finish = F.when(F.col("turn") % 3 == 0, "length").when(F.col("turn") % 3 == 1, "stop").otherwise("unknown")
    return p.select("original_index", "id", "conv_id", "turn", query.alias("query"), resp.alias("response"),
                    finish.alias("finish_reason"), "rewrite",
                    F.col("response").alias("unedited"))


MUTATED_PAIRS_SQL = f"""(SELECT original_index, id, conv_id, turn, response AS unedited,
    CASE conv_id % 4 WHEN 1 THEN 'ACME GPU: ' || query
                     WHEN 2 THEN query || ' How many items cost 12 and 5 in total?'
                     WHEN 3 THEN 'Write exactly 3 bullet points in JSON: ' || query
                     ELSE query END AS query,
    CASE conv_id % 9 WHEN 0 THEN 'Assistant: ' || response
                     WHEN 1 THEN '<think>draft plan</think>' || response || ' (see'
                     WHEN 2 THEN response || chr(10) || '2.'
                     WHEN 3 THEN response || ' and'
                     WHEN 4 THEN response || ' ' || chr(28450) || chr(23383) || ' ACME.'
                     WHEN 5 THEN '```text' || chr(10) || response || chr(10) || '```'
                     WHEN 6 THEN response || chr(10) || chr(10) || chr(10) || chr(10) || 'Summary:'
                     WHEN 7 THEN 'None of the passages at hand settles this; name one document or section to look at. ' || response
                     ELSE response || ' Reported by Jane Smith at WHO [1] www.example' END AS response0,
    CASE turn % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' ELSE 'unknown' END AS finish_reason, rewrite
   FROM {PAIRS_SQL} pp)"""
MUTATED_PAIRS_SQL = f"""(SELECT original_index, id, conv_id, turn, query, finish_reason, rewrite, unedited,
    CASE conv_id % 7 WHEN 3 THEN r1 || ' token = "0123456789abcdef0123"'
                     WHEN 5 THEN r1 || ' Mail 12@mail1.example.com.' ELSE r1 END AS response
   FROM (SELECT *, CASE conv_id % 5 WHEN 2 THEN 'Revision note: wording kept as submitted. ' || response0
                                    ELSE response0 END AS r1 FROM {MUTATED_PAIRS_SQL} m0) m1)"""
