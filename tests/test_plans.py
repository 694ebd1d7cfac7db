"""The shape of the plans: what runs where, what is read, what is limited before a shuffle."""

from __future__ import annotations

import os
import re

import pytest

from repoquarry.workload import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(spark, name):
    return load()[0][name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["recent_authors", "recent_commits", "change_frequency", "commit_digest", "file_history", "classify_basic", "sample_files",
     "top_languages", "head_per_directory", "head_per_level", "first_files", "top_k_similar", "search_docs"],
)
def test_ranks_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["scan_files", "directory_counts", "directory_totals", "total_files", "classify_basic", "language_file_counts", "sample_files", "directory_text"])
def test_contents_are_not_read(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and not any("text:" in s for s in schemas)


def test_answers_need_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "parse_important_files")


def test_ids_are_never_collected(spark):
    # Only lists of bounded groups are collected; the per-file tables stay rows.
    for name in ("language_lines", "commit_totals", "total_files", "content_stats", "diff_snapshots", "term_index", "chunk_text"):
        assert "collect_list" not in plan(spark, name), name


def test_snapshots_are_shuffled_once(spark, tmp_path):
    from repoquarry.operators import snapshots

    made = spark.range(100).selectExpr("'r' as repo_id", "concat('p', id) as path", "concat('b', id % 7) as blob")
    made.write.parquet(str(tmp_path / "a"))
    made.filter("path not like '%3'").selectExpr("repo_id", "concat(path, 'x') as path", "blob").write.parquet(str(tmp_path / "b"))
    diff = snapshots.diff_snapshots(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")))
    diff.collect()
    final = diff._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2


@pytest.mark.parametrize("name", ["language_lines", "attach_files", "repo_profile", "language_summary_text", "chunk_text", "term_index", "mask_sensitive"])
def test_contents_are_read_once(spark, name):
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert sum("text:" in s for s in scans) == 1
