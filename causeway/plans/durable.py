"""Intermediate results that outlive a lost executor.

Iterative jobs cut their lineage by writing a table into the folder that the
cluster shares (``spark.checkpoint.dir``).  Block-manager copies are never
used, as they vanish with the executor that holds them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: How many times larger than its file a table is taken to be when Spark asks whether to send it whole to every executor.
SPREAD, _SPREAD = 16.0, "spark.sql.sources.fileCompressionFactor"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is configured, a fresh temporary one if all runs in one process, else ``RuntimeError``."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="causeway-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all this application has written."""
    return f"{shared_dir(spark)}/causeway-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def sized(spark: SparkSession) -> None:
    """Let this session expect rows in memory to take :data:`SPREAD` times the room of their files, if it expects less.

    Labels and ids that repeat take a byte or two in Parquet and dozens in a hash table on the driver.  Tables that are small in truth are still sent
    whole, as Spark decides again by what it has shuffled.
    """
    if float(spark.conf.get(_SPREAD)) < SPREAD:
        spark.conf.set(_SPREAD, str(SPREAD))


def repeated(rows: DataFrame, name: str, times: int) -> DataFrame:
    """``rows``, each ``times`` times, with a number from 0 in column ``name``.

    Unlike an ``explode``, which Spark takes to make no table larger, a join with the numbers has it expect the rows that come out.
    """
    numbers = rows.sparkSession.range(times).withColumnRenamed("id", name)
    return rows.crossJoin(F.broadcast(numbers))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again (lineage ends there)."""
    spark = df.sparkSession
    sized(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/causeway-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
