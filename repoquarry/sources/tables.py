"""Reading commit logs, file changes and model answers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry import schemas
from repoquarry.functions import text


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table in parquet, orc, json or csv; columns missing in the data come back null."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def scan_commits(source: DataFrame) -> DataFrame:
    """Commit log: messages stripped, unused columns left out. Position `seq` is kept when present."""
    order = [F.col("seq")] if "seq" in source.columns else []
    return source.select(
        "repo_id", "commit_id", "author", "ts", text.strip_text("message").alias("message"), *order
    )


def scan_changes(source: DataFrame) -> DataFrame:
    """One row per changed file and commit, against the first parent only.

    Takes a flat table (with an optional `parent_no`) or a nested export with `files_changed`.
    """
    if "files_changed" in source.columns:
        nested = source.select(
            "repo_id", F.col("commit_hash").alias("commit_id"), F.col("date").alias("ts"), F.explode("files_changed").alias("change")
        )
        source = nested.select("repo_id", "commit_id", "ts", "change.*")
    if "parent_no" in source.columns:
        source = source.filter(F.coalesce("parent_no", F.lit(1)) == 1).drop("parent_no")
    time = [F.col("ts")] if "ts" in source.columns else []
    # The new path names the file; a deletion may only carry the old one.
    return source.select(
        "repo_id",
        "commit_id",
        F.coalesce("file_path", "old_path").alias("file_path"),
        "change_type",
        F.when(F.col("change_type").startswith("R"), F.col("old_path")).alias("old_path"),
        F.coalesce("lines_added", F.lit(0)).cast("bigint").alias("lines_added"),
        F.coalesce("lines_deleted", F.lit(0)).cast("bigint").alias("lines_deleted"),
        *time,
    )


def commits_of_export(source: DataFrame) -> DataFrame:
    """Flat commit log of a nested export."""
    return scan_commits(
        source.select("repo_id", F.col("commit_hash").alias("commit_id"), "author", F.col("date").alias("ts"), "message")
    )


def read_responses(source: DataFrame) -> DataFrame:
    """Model answers as text, one row each; answers without text are left out."""
    return source.select("repo_id", "response_id", "text").filter(F.col("text").isNotNull())


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON lines export of a log."""
    return read_table(spark, path, schemas.COMMIT_EXPORT, "json")
