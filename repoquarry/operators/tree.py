"""Directories and files of the tree. Inputs are tables with `(repo_id, path)`; contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import paths
from repoquarry.operators.skew import first_rows, paged_lists
from repoquarry.sources.tree import file_tree


def directory_index(files: DataFrame, page_size: int = 1000) -> DataFrame:
    """`(repo_id, dir, page, pages, files)`: sorted file names per directory.

    A directory of ordinary size is one row. `file_tree` is the flat form of the same data.
    """
    return paged_lists(file_tree(files), ["repo_id", "dir"], ["name"], F.col("name"), page_size, "files")


def flatten_index(index: DataFrame) -> DataFrame:
    """`(repo_id, path)` of a directory index with `dir` and an array `files`."""
    names = index.select("repo_id", "dir", F.explode("files").alias("name"))
    return names.select("repo_id", paths.full_path("dir", "name").alias("path"))


def directory_totals(files: DataFrame) -> DataFrame:
    """`(repo_id, dir, file_count)` of every directory holding files."""
    return file_tree(files).groupBy("repo_id", "dir").agg(F.count("*").alias("file_count"))


def directory_counts(files: DataFrame, n: int = 10) -> DataFrame:
    """Files per directory for the first n directories of each repository."""
    return first_rows(directory_totals(files), ["repo_id"], [F.asc("dir")], n)


def total_files(files: DataFrame) -> DataFrame:
    return file_tree(files).groupBy("repo_id").agg(F.count("*").alias("total_files"))


def head_per_directory(files: DataFrame, n: int = 10) -> DataFrame:
    """`(repo_id, dir, rank, name, more)`: the first n names of each directory and how many are left out.

    Names are ranked with a group limit and counted by an aggregation, so a directory with a huge number of files is
    never sorted or buffered in one task.
    """
    tree = file_tree(files)
    head = first_rows(tree, ["repo_id", "dir"], [F.asc("name")], n).drop("path")
    more = directory_totals(files).select("repo_id", "dir", F.greatest(F.col("file_count") - n, F.lit(0)).alias("more"))
    return head.join(more, ["repo_id", "dir"])
