"""Written steps of a job that a restart reads instead of running them again.

A step is named by a digest of all that its rows follow from: the digests of the
tables or steps before it and the settings of the job.  Its rows are Parquet
under ``<root>/<step>-<digest>``; a marker is written last, with the counters
observed by that very write.  A step whose marker is there is read; one without
is run, over whatever a killed job left of it.  So a restarted job asks a model
only for the steps (or slices of a step) that were not finished, and a job with
other inputs or settings shares nothing with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.session import new_folder


def content_digest(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order and partitions: one aggregation."""
    known = sorted(df.columns)
    row = df.select(F.xxhash64(*known).alias("a"), F.xxhash64(F.lit(1), *known).alias("b")).agg(
        F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)")), F.bit_xor("a")).first()
    return digest(df.select(*known).schema.simpleString(), *map(str, row))


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Step:
    """A finished step: its rows, its digest, the counters of its write, and whether a former run wrote it."""

    rows: DataFrame
    digest: str
    counters: dict
    reused: bool


class Stages:
    """The steps of one job under ``root``; without a root, in a new folder of the shared one (nothing to resume)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or new_folder(spark)).rstrip("/")

    def _marker(self, path: str) -> dict | None:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return None
        found = self.spark.read.text(f"{path}/done").collect()
        return json.loads(found[0].value) if found else None

    def _write(self, rows: DataFrame, path: str, counters: dict[str, Column]) -> dict:
        seen = Observation()
        watched = rows.observe(seen, *[c.alias(k) for k, c in counters.items()]) if counters else rows
        watched.write.mode("overwrite").parquet(f"{path}/rows")
        out = dict(seen.get) if counters else {}
        self.spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/done")
        return out

    def run(self, name: str, after: tuple, build: Callable[[Callable], DataFrame], counters: dict[str, Column] | None = None,
            slices: int = 1, slice_by: str | None = None) -> Step:
        """The step ``name`` over what ``after`` names (digests, settings), built only if it isn't there yet.

        ``build(cut)`` gives the rows.  ``slices`` has the step built in parts that are finished
        one after another, so a killed job loses one part: ``cut`` keeps the input rows of a part
        (by a hash of ``slice_by``), and the builder applies it before it asks a model.
        ``counters`` are aggregates of the rows, whole numbers that add up over the parts; they
        are taken while the rows are written.
        """
        if slices > 1 and slice_by is None:
            raise ValueError("slices need a column to cut by")
        own = digest(name, *after)
        base = f"{self.root}/{name}-{own}"
        paths = [base if slices == 1 else f"{base}/{k}-of-{slices}" for k in range(slices)]
        found = [self._marker(p) for p in paths]
        reused, schema = all(f is not None for f in found), None
        for k, path in enumerate(paths):
            if found[k] is None:
                mine = F.pmod(F.xxhash64(slice_by), F.lit(slices)) == k if slices > 1 else None
                rows = build(lambda df: df if mine is None else df.where(mine))
                schema = rows.schema
                found[k] = self._write(rows, path, counters or {})
        total = {c: sum(f[c] or 0 for f in found) for c in counters or {}}
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return Step(reader.parquet(*[f"{p}/rows" for p in paths]), own, total, reused)
