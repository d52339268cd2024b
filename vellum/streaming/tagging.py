"""Structured Streaming forms of the row-local jobs.

Normalization, tagging and routing (B1-B3, C1-C6) are per-row, so the batch
operators run unchanged on a streaming DataFrame.  ``tag_stream`` appends
tagged rows to a Parquet sink; ``route_count_stream`` keeps running route
counts (G1) in complete mode and rewrites them each micro-batch.  Both use the
``availableNow`` trigger (process what is there, then stop) and a checkpoint
location, so a restarted or failed query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.normalize import normalize_table
from vellum.operators.tagging import tag_and_route
from vellum.packs import Pack


def tagged_stream(spark: SparkSession, source_dir: str, schema: str, text_col: str, pack: Pack,
                  max_chars: int | None = None, max_files_per_trigger: int | None = None,
                  path_glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    src = normalize_table(src, text_col, "text_norm", "text_compact", max_chars=max_chars)
    return tag_and_route(src, "text_norm", pack, "text_compact")


def tag_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str,
               text_col: str, pack: Pack, key_cols: list[str], path_glob: str | None = None) -> StreamingQuery:
    """Append ``key_cols + severity, categories, route_name`` for each new input file."""
    t = tagged_stream(spark, source_dir, schema, text_col, pack, path_glob=path_glob)
    out = t.select(*key_cols, "severity", "categories", "route_name")
    return (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())


def route_count_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, schema: str,
                       text_col: str, pack: Pack, path_glob: str | None = None) -> StreamingQuery:
    """Running rows-per-route counts, rewritten as a small Parquet table each micro-batch."""
    t = tagged_stream(spark, source_dir, schema, text_col, pack, path_glob=path_glob)
    counts = t.groupBy("route_name").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(sink_dir)

    return (counts.writeStream.outputMode("complete").foreachBatch(write)
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
