"""Totals kept by differences: what a change removes is subtracted, what it brings is added, and nothing else is looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators.languages import sorted_struct
from repoquarry.operators.snapshots import file_stats

_KEYS = ["repo_id", "language"]


def language_totals(stats: DataFrame) -> DataFrame:
    """`(repo_id, language, line_count, files)` of the files of `file_stats` that are not ignored; a null language is one of its own."""
    counted = stats.filter("not is_ignored")
    lines = F.sum(F.when(F.col("language").isNotNull(), F.col("line_count")))
    return counted.groupBy(*_KEYS).agg(F.coalesce(lines, F.lit(0)).alias("line_count"), F.count("*").alias("files"))


def changed_stats(previous: DataFrame, changes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `previous` (`file_stats`) that the changes of `diff_snapshots` remove, and the rows they bring.

    Contents are read of added, modified and renamed files only.
    """
    old = changes.select("repo_id", F.when(F.col("change_type") == "R", F.col("old_path")).when(F.col("change_type").isin("D", "M"), F.col("file_path")).alias("path"))
    new = changes.filter("change_type <> 'D'").select("repo_id", F.col("file_path").alias("path"))
    keys = ["repo_id", "path"]
    return previous.join(old.filter("path is not null"), keys, "left_semi"), file_stats(files.join(new, keys, "left_semi"))


def next_stats(previous: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """`file_stats` of the later snapshot."""
    return previous.join(gone.select("repo_id", "path"), ["repo_id", "path"], "left_anti").unionByName(fresh.select(*previous.columns))


def retract(totals: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """The totals after a change. A language whose last file has gone has no row."""
    minus = language_totals(gone).select(*_KEYS, (-F.col("line_count")).alias("line_count"), (-F.col("files")).alias("files"))
    rows = totals.unionByName(minus).unionByName(language_totals(fresh))
    return rows.groupBy(*_KEYS).agg(F.sum("line_count").alias("line_count"), F.sum("files").alias("files")).filter("files <> 0")


def totals_profile(totals: DataFrame) -> DataFrame:
    """`(repo_id, total_files, total_lines, primary_language, languages)` of stored totals; languages by lines."""
    known = totals.filter("language is not null").groupBy("repo_id").agg(sorted_struct("language", "line_count", "files").alias("languages"))
    sums = totals.groupBy("repo_id").agg(F.sum("files").alias("total_files"), F.sum("line_count").alias("total_lines"))
    joined = sums.join(known, "repo_id", "left")
    first = F.try_element_at("languages", F.lit(1))["language"]
    return joined.select("repo_id", "total_files", "total_lines", F.coalesce(first, F.lit("Unknown")).alias("primary_language"), "languages")
