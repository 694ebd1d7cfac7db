"""Commit history: totals, authors, newest commits, change frequency, file histories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions import fixed
from repoquarry.operators.skew import first_rows, paged_lists, spread_join


def log_order(commits: DataFrame) -> list[Column]:
    """Newest first: by log position where the table has one, else by time and id."""
    if "seq" in commits.columns:
        return [F.asc("seq")]
    return [F.desc("ts"), F.desc("commit_id")]


def newest(commits: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """The n newest commits per repository, ranked from 1."""
    return first_rows(commits, ["repo_id"], log_order(commits), n, rank)


def commit_totals(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id").agg(F.count("*").alias("total_commits"))


def recent_authors(commits: DataFrame, n: int = fixed.AUTHOR_COMMITS) -> DataFrame:
    """`(repo_id, authors, authors_count)`: distinct names over the n newest commits, sorted."""
    authors = F.sort_array(F.collect_set("author"))
    recent = newest(commits, n).groupBy("repo_id").agg(authors.alias("authors"))
    return recent.withColumn("authors_count", F.size("authors").cast("bigint"))


def _last(commits: DataFrame) -> list[Column]:
    """Id and time of the newest commit as aggregates: the first in the log if it is numbered, else the latest."""
    if "seq" in commits.columns:
        last, when = F.min_by("commit_id", "seq"), F.min_by("ts", "seq")
    else:
        last, when = F.max_by("commit_id", F.struct("ts", "commit_id")), F.max("ts")
    return [last.alias("last_commit"), when.alias("last_commit_date")]


def latest_commit(commits: DataFrame) -> DataFrame:
    """`(repo_id, last_commit, last_commit_date)` of the newest commit; plain aggregation, no sort."""
    return commits.groupBy("repo_id").agg(*_last(commits))


def commit_overview(commits: DataFrame) -> DataFrame:
    """Totals and newest commit of each repository in one aggregation."""
    return commits.groupBy("repo_id").agg(F.count("*").alias("total_commits"), *_last(commits))


def recent_commits(commits: DataFrame, n: int = fixed.RECENT_COMMITS, since: datetime | str | None = None) -> DataFrame:
    """The n newest commits, ending before the first one older than `since`."""
    recent = newest(commits, n)
    if since is None:
        return recent
    # At most n rows per repository are left here, so the running minimum is cheap.
    so_far = Window.partitionBy("repo_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    young = F.col("ts") >= F.lit(since).cast(commits.schema["ts"].dataType)
    return recent.withColumn("_young", F.min(young).over(so_far)).filter("_young").drop("_young")


def change_frequency(
    commits: DataFrame,
    changes: DataFrame,
    n: int = fixed.FREQUENCY_COMMITS,
    threshold: int = fixed.FREQUENCY_THRESHOLD,
) -> DataFrame:
    """`(repo_id, file_path, change_count)`: changes per file over the n newest commits, at least `threshold`."""
    named = changes.select("repo_id", "commit_id", "file_path").filter(F.col("file_path").isNotNull())
    counted = changes_of(named, newest(commits, n)).groupBy("repo_id", "file_path").agg(F.count("*").alias("change_count"))
    return counted.filter(F.col("change_count") >= threshold)


def changes_of(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changes belonging to the given few commits; one commit may hold very many of them."""
    keys = ["repo_id", "commit_id"]
    return spread_join(changes, commits.select(*keys), keys, "file_path", "left_semi")


def commit_rollup(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with `file_count`, `total_additions`, `total_deletions`; commits without changes stay with zeros."""
    totals = changes.groupBy("repo_id", "commit_id").agg(
        F.count("*").alias("file_count"),
        F.sum("lines_added").alias("total_additions"),
        F.sum("lines_deleted").alias("total_deletions"),
    )
    numbers = ["file_count", "total_additions", "total_deletions"]
    return commits.join(totals, ["repo_id", "commit_id"], "left").fillna(0, numbers)


def commit_files(changes: DataFrame, page_size: int = 1000) -> DataFrame:
    """`(repo_id, commit_id, page, pages, files_changed)`: the changes of each commit as arrays.

    An ordinary commit is one row; an import of millions of files is many pages.
    """
    change = F.struct("file_path", "change_type", "old_path", "lines_added", "lines_deleted")
    order = ["file_path", "change_type", "old_path", "lines_added", "lines_deleted"]
    return paged_lists(changes, ["repo_id", "commit_id"], order, change, page_size, "files_changed")


def file_history(
    commits: DataFrame, changes: DataFrame, file_path: str | None = None, n: int = fixed.HISTORY_COMMITS
) -> DataFrame:
    """`(repo_id, file_path, commit columns, rank)`: the n newest commits touching a file, or every file."""
    touched = changes.select("repo_id", "commit_id", "file_path")
    if file_path is not None:
        touched = touched.filter(F.col("file_path") == file_path)
    # A commit may list a file twice; equal ranks keep such rows together until they are dropped below.
    ranks = F.dense_rank().over(Window.partitionBy("repo_id", "file_path").orderBy(*log_order(commits)))
    # Only what orders the log goes through the ranking; authors and messages join the commits that are left.
    narrow = [c for c in ("ts", "seq") if c in commits.columns]
    joined = touched.distinct().join(commits.select("repo_id", "commit_id", *narrow), ["repo_id", "commit_id"])
    newest_first = joined.withColumn("rank", ranks).filter(F.col("rank") <= n).drop(*narrow)
    return newest_first.join(commits, ["repo_id", "commit_id"])
