"""Session settings, the shared work folder and staged tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.openCostInBytes", "256k")  # small files still use all cores
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, the checkpoint folder of the context is used; with
    neither, a folder inside the warehouse. On a cluster that must not be a folder
    of one machine: each executor would write to its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and (folder.startswith("file:") or "://" not in folder):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the work folder."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage of loops, survives the loss of executors, and gives the
    planner true file sizes for its join choices.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_at = path
    return written


def release(*staged: DataFrame | None) -> None:
    """Delete tables written by ``stage`` that no plan needs any more."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that nothing refers to any more. It does so
    when the driver collects garbage, which a driver with little to do rarely does, and the
    files of a long chain of jobs would stay on the executors' disks until its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
