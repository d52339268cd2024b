"""A6/H9 as a keyed stream: the last assessment of every id, kept as state while JSONL files arrive.

"Last" is the order of the batch form: file path, block of the file, row.  A row
therefore carries its place, the state of an id is its assessment with the
greatest place, and files may arrive in any order.  What changed goes out with
each micro-batch under its number, so a batch that is written again after a
restart replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.sources.io import ASSESSMENT_SCHEMA

PLACE = "file string, block long, row long"
LATEST = f"id string, {PLACE}, assessment string"


def placed_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files under ``path`` as a stream, each with its file, block and row in the block."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}  # rows so far of the splits of this task
        for pdf in batches:
            split = list(zip(pdf["file"], pdf["block"]))
            rows = []
            for s in split:
                rows.append(seen.get(s, 0))
                seen[s] = rows[-1] + 1
            yield pdf.assign(row=rows)

    return lines.mapInPandas(number, f"value string, {PLACE}")


def latest_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The last assessment of every id that a micro-batch touched, with its place, as JSON (update mode).

    Blank lines are skipped; a line that is no JSON object or has no id fails the query."""
    lines = placed_lines(spark, path, files_per_batch).where(F.trim("value") != "")
    found = F.get_json_object("value", "$.id")
    rows = lines.select(F.coalesce(found, F.raise_error(F.lit("an assessment has no id")).cast("string")).alias("id"),
                        "file", "block", "row", F.col("value").alias("assessment"))
    # the state of an id is one row; rows of a task are reduced to one an id before the exchange
    return rows.groupBy("id").agg(F.max(F.struct("file", "block", "row", "assessment")).alias("last")).select("id", "last.*")


def write_latest(latest: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over the files that are there (availableNow); changes of batch n lie in ``<out>/batch=<n>``."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def latest_table(spark: SparkSession, out: str) -> DataFrame:
    """The last assessment of every id, equal to ``last_by_id`` of the same files: the newest of its changes."""
    changes = spark.read.schema(f"{LATEST}, batch long").parquet(out)
    newest = changes.groupBy("id").agg(F.max_by("assessment", F.struct("file", "block", "row")).alias("assessment"))
    schema = ", ".join(c for c in ASSESSMENT_SCHEMA.split(", ") if not c.startswith("id "))
    return newest.select("id", F.from_json("assessment", schema).alias("a")).select("id", "a.*")
