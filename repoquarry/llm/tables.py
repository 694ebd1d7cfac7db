"""Intermediate tables in the folder all executors share, and Arrow functions on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import repoquarry
from repoquarry.llm.texts import give_back
from repoquarry.session import shared_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that they can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(repoquarry.__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="repoquarry-package-"), "repoquarry-package")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` by workers that have this package and give their memory back at the end of a task."""
    ship(df.sparkSession)

    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return df.mapInArrow(freed, schema)


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/repoquarry-llm-{spark.sparkContext.applicationId}"


TABLE_PREFIX = "llm_"
"""Names of bucketed tables begin with it."""

_OPEN: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("_OPEN", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those that are kept; what is kept must be read from a kept table."""
    mine: list[tuple[str, str | None]] = []
    token = _OPEN.set(mine)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path, table in mine:
            if table:
                spark.sql(f"drop table if exists {table}")
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _new_path(spark: SparkSession, name: str, table: str | None = None, keep: bool = False) -> str:
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not keep and (mine := _OPEN.get()) is not None:
        mine.append((path, table))
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, kept when executors are lost, lineage cut."""
    path = _new_path(df.sparkSession, name, keep=keep)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._path, stored._table = path, None
    return stored


def kept_apart(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows as a stored table bucketed by the key, each written by the task that has it: joins on the key find them where they are."""
    spark = df.sparkSession
    table = f"{TABLE_PREFIX}{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = _new_path(spark, name, table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    stored._path, stored._table = path, table
    return stored


def discard(stored: DataFrame) -> None:
    """Removes a table from `written` or `kept_apart` that nothing will read any more."""
    if stored._table:
        stored.sparkSession.sql(f"drop table if exists {stored._table}")
    _delete(stored.sparkSession, stored._path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> str:
    """Name of a table of the rows in the shared folder, bucketed and sorted by the keys: joins on them do not move it again."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{TABLE_PREFIX}{name}_{uuid.uuid4().hex[:12]}"
    stored = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    stored.option("path", _new_path(spark, name, table)).saveAsTable(table)
    return table


def clear(spark: SparkSession) -> None:
    """Removes the tables this application has written; results not yet stored elsewhere are lost with them."""
    for table in spark.catalog.listTables():
        if table.name.startswith(TABLE_PREFIX):
            spark.sql(f"drop table if exists {table.name}")
    _delete(spark, _root(spark))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """Rows with the one row of their group in `groups`, a stored table with the number of rows per group in `size`.

    Groups with more than 1/`share` of all rows are fewer than `share`, so they are broadcast and their rows stay where they are. All
    other groups are small against a task, and join by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * share > total
    flagged = rows.join(F.broadcast(groups.filter(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    of_hot = flagged.filter("_hot").drop("_hot").join(F.broadcast(groups.filter(hot)), keys)
    return of_hot.unionByName(flagged.filter("_hot is null").drop("_hot").join(groups.filter(~hot), keys))
