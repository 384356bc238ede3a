"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session. Timestamps in the bank tables carry no
# zone, so one fixed zone keeps date arithmetic the same on every cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",  # merge up to the advisory size
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key may hold a third of a table: split it even where that costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: bound what a Python worker holds
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator here assumes; cheap and safe to repeat."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "bankspark", cores: str = "8") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine (``local``, ``local[n]``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a session that is one process (tests) may do without: it gets a fresh temporary folder,
    remembered in the session. Anywhere else a missing setting is an error, since a folder of one
    machine would lose the rows that other machines write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("bankspark.scratch.dir", None)
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bankspark-")
        spark.conf.set("bankspark.scratch.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/bankspark/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder once and go on from the written rows.

    The rows survive the loss of executors, they are computed a single time, and Spark knows the
    size of what it reads back.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, total: int, *columns: str, rows: int = 250_000) -> DataFrame:
    """``df`` of ``total`` rows dealt by ``columns`` over tasks of about ``rows`` rows; a smaller table stays as it is.

    Tasks of a given number are kept as they are; otherwise Spark merges them by their compressed bytes.
    """
    return df.repartition(-(-total // rows), *columns) if total > rows else df


def by_rows(df: DataFrame) -> DataFrame:
    """``df`` for the other side of a join by a key of many rows: both sides are sorted, neither is broadcast.

    Spark sizes written tables by their compressed files, and sends ones of many rows through the driver.
    """
    return df.hint("merge")


def fewer_tasks(df: DataFrame, total: int, rows: int = 250_000) -> DataFrame:
    """``df`` of ``total`` kept rows, its partitions joined to one per ``rows`` rows, or two per core where those are more.

    A shuffle leaves as many partitions as the session's setting says; passes over few rows would wait for empty tasks.
    """
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // rows))
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df  # joining none could still change their order


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers of a cluster need not have it installed, and a driver may be started from any folder.
    """
    if spark.conf.get("bankspark.shipped", None) == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="bankspark-"), "bankspark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("bankspark.shipped", spark.sparkContext.applicationId)
