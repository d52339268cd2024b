"""Spark session and staging helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "vellum", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests.  On a cluster, use the session you are given."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # text jobs are CPU-bound: bytes per partition understate the work, so do
         # not let AQE merge small shuffles below this size into a single task
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
         # small local tables are often one row group, hence one split
         .config("spark.vellum.scanPartitions", str(parts))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "16g"))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    It is only read.  Unset is an error, but for a local master (tests): there
    driver and executors are one process, and a private folder will do.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="vellum-staged-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Folders that this process has made in the shared one, by application.
MADE: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one; ``discard_staged`` knows it."""
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_staged(spark: SparkSession, path: str | None = None) -> int:
    """Delete what ``staged`` and jobs without a folder of their own have written, or one such folder.

    For the end of a job: rows that still have to be read are gone.  Other folders are not touched."""
    made = MADE.get(spark.sparkContext.applicationId, [])
    gone = [p for p in made if path is None or p == path]
    for p in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        made.remove(p)
    return len(gone)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over the session's shuffle partitions, four for each core at least.

    For jobs that work long on few bytes: cut by bytes, they get about as many tasks as there are
    cores, and one more makes a second round.  A join or grouping by ``key`` needs no other shuffle."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs only the tasks that read its part, model output is not
    computed again, and later readers scan only the columns that they need."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
