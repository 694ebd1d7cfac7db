"""Session defaults. On a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster sets its own sizes and lets AQE merge small partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("repoquarry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables named by the cluster.

    Only where none is set and all runs on this machine (tests, a laptop) a temporary folder is taken; executors elsewhere could not
    see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder is None and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="repoquarry-"))
    return folder or context.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that Python functions find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="repoquarry-package-"), "repoquarry")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as Parquet in a folder that executors share: computed once, packed, with the lineage cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a table of `stored` that nothing will read any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
