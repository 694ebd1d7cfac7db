"""Writing reports and profiles.

Reports are tables of lines. They are written range-partitioned by their order, so the lines of one huge repository
spread over several text files whose name order is the line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(report: DataFrame, path: str, order: list[str], column: str = "line", mode: str = "overwrite") -> None:
    """Text files per repository of a line table `(repo_id, ..., line)`."""
    (
        report.repartitionByRange("repo_id", *order)
        .sortWithinPartitions("repo_id", *order)
        .select("repo_id", F.col(column).alias("value"))
        .write.mode(mode)
        .partitionBy("repo_id")
        .text(path)
    )


def write_important_files_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes the table made by `plans.reports.important_files_report`."""
    write_lines(report, path, ["level_rank", "ordinal", "file_path", "line_no"], mode=mode)


def write_overview_report(overview: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text per repository from `overview(repo_id, overview)`."""
    overview.select("repo_id", F.col("overview").alias("value")).write.mode(mode).partitionBy("repo_id").text(path)


def profile_json(profile: DataFrame) -> DataFrame:
    """`(repo_id, json)`: each row as one JSON text; timestamps as text, non-ASCII kept."""
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "ignoreNullFields": "false"}
    return profile.select("repo_id", F.to_json(F.struct("*"), options).alias("json"))


def write_profile_json(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    profile.write.mode(mode).option("ignoreNullFields", "false").json(path)
