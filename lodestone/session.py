"""Session helpers: sensible defaults, table loading, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes in memory that a byte of a Parquet file may stand for: repetitive columns take a few bytes a row there.
FILE_FACTOR = "64.0"
#: Bytes of input for a partition to begin with, and of a shuffle's partition.
INPUT_PART, SHUFFLE_PART = 4 << 20, 16 << 20


def session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.fileCompressionFactor": FILE_FACTOR,
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it.

    On a cluster ship the package with --py-files; this covers local use.
    """
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])


def file_sizes(spark: SparkSession) -> None:
    """Let the planner count tables by what they take in memory, not by their compressed files.

    Otherwise millions of short rows pass for a few MB and are broadcast through the
    driver. Shuffled joins still become broadcasts where the rows prove to be few.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) < float(FILE_FACTOR):
        spark.conf.set(key, FILE_FACTOR)


def shuffle_sizes(spark: SparkSession, sf_dir: str) -> None:
    """Let larger tables mean more partitions, not larger ones: what a task sorts or groups stays as it is.

    Adaptive execution begins with a partition for every INPUT_PART of the folder's
    files, joins them again to SHUFFLE_PART at most, and scans read as little at once.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_PART), ("spark.sql.files.maxPartitionBytes", 2 * SHUFFLE_PART)):
        if size(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    if not sf_dir:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    held = files.getContentSummary(path).getLength() if files.exists(path) else 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // INPUT_PART))))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to a few tasks for every core.

    A file of millions of short rows is only a few MB, which one task would read and
    work on alone. A stated number of partitions is one that Spark doesn't join again.
    """
    spark = rows.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, *(int(spark.conf.get(k, "1")) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")))
    return rows.repartition(tasks, *keys)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data folder, pruned to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    That is spark.checkpoint.dir. Where it is unset a local session, as in tests,
    takes a temporary folder of this machine; a cluster has to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to shared storage and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of materialised frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
