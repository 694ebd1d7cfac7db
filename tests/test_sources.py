from __future__ import annotations

import glob
import json
import os
import re
import subprocess

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry import schemas
from repoquarry.operators import contents, languages
from repoquarry.plans import profile, reports
from repoquarry.sources import sinks, tables
from repoquarry.sources.tree import file_tree, list_tree, scan_files


@pytest.fixture
def tree(tmp_path):
    made = {
        "README.md": b"# T\nhello\n", "src/__init__.py": b"", "src/_x.py": b"a\nb", "src/a b.py": b"x\xff\n", ".env": b"S=1\n",
        "node_modules/z.js": b"1\n", "src/.hidden/y.py": b"1\n", "deep/er/still/m.go": b"package m\n",
    }
    for path, data in made.items():
        target = tmp_path / "repo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return str(tmp_path / "repo"), made


def test_tree_keeps_underscore_files(spark, tree):
    root, made = tree
    repos = spark.createDataFrame([("r", root)], "repo_id string, root string")
    listing = list_tree(repos, keep_ignored=True)
    assert {r.path for r in listing.collect()} == set(made)
    assert {r.path for r in list_tree(repos, levels=1).collect()} == {p for p in made if not re.search(r"(^|/)([.]|node_modules/)", p)}
    files = scan_files(listing)
    got = {r.path: (r.content, r.size) for r in files.collect()}
    assert got == {
        "README.md": ("# T\nhello\n", 10), "src/__init__.py": ("", 0), "src/_x.py": ("a\nb", 3), "src/a b.py": ("x�\n", 3), "deep/er/still/m.go": ("package m\n", 10),
    }
    assert scan_files(listing, keep_ignored=True).count() == len(made)
    assert file_tree(files).filter("dir = 'src'").count() == 3
    assert ("r", "Python", 3) in rows(languages.language_lines(files))
    missing = spark.createDataFrame([("r", root, "gone.py")], schemas.LISTING)
    assert rows(scan_files(missing).select("path", "content", "size", "blob")) == [("gone.py", None, 0, None)]


def test_tables_round_trip(spark, tmp_path, sample):
    _, commits, changes = sample
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = commits.write.format(fmt)
        (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)
        back = tables.read_table(spark, path, schemas.COMMITS.removesuffix(", seq bigint"), fmt)
        assert rows(tables.scan_commits(back).select("commit_id", "author", "message"), "commit_id") == [
            ("c1", "Ann", "Initial commit"), ("c2", "Bob", "Added comment to main.py"),
        ]


def test_nested_export(spark, tmp_path, sample):
    _, commits, changes = sample
    nested = changes.groupBy("repo_id", F.col("commit_id").alias("commit_hash")).agg(
        F.collect_list(F.struct("file_path", "change_type", "old_path", "lines_added", "lines_deleted")).alias("files_changed")
    )
    whole = nested.join(commits.withColumnsRenamed({"commit_id": "commit_hash", "ts": "date"}), ["repo_id", "commit_hash"])
    whole.write.json(str(tmp_path / "log"))
    back = tables.read_export(spark, str(tmp_path / "log"))
    assert rows(tables.scan_changes(back).drop("ts"), "commit_id", "file_path") == rows(changes, "commit_id", "file_path")
    assert {(r.commit_id, r.ts) for r in tables.scan_changes(back).collect()} == {(r.commit_id, r.ts) for r in commits.collect()}
    assert tables.commits_of_export(back).count() == 2


def test_only_first_parent_counts(spark):
    merged = spark.createDataFrame(
        [("r", "c", "a", "M", None, 1, 1, None, 1), ("r", "c", "b", "M", None, 1, 1, None, 2), ("r", "c", None, "D", "gone", None, 3, None, None)], schemas.FILE_CHANGES
    )
    got = rows(tables.scan_changes(merged), "file_path")
    assert got == [("r", "c", "a", "M", None, 1, 1, None), ("r", "c", "gone", "D", None, 0, 3, None)]


def _text(folder):
    parts = sorted(glob.glob(os.path.join(folder, "part-*")))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_report_sinks(spark, tmp_path, sample):
    files, commits, _ = sample
    important = spark.createDataFrame(
        [("s", "main.py", "CRITICAL", 0.5, ["entry"], "Code", 1, 0), ("s", "README.md", "HIGH", 0.25, ["doc", "text"], "Doc", 1, 1), ("s", "x", "LOW", 0.1, [], "t", 1, 2)],
        schemas.IMPORTANT_FILES,
    )
    sinks.write_important_files_report(reports.important_files_report(important), str(tmp_path / "report"))
    assert _text(str(tmp_path / "report" / "repo_id=s")) == (
        "# Important Files Analysis\n\n**Analysis Confidence**: 38.3%\n\n## CRITICAL Files\n\n### `main.py`\n- **Type**: Code\n- **Confidence**: 50.0%\n"
        "- **Reasons**: entry\n\n## HIGH Files\n\n### `README.md`\n- **Type**: Doc\n- **Confidence**: 25.0%\n- **Reasons**: doc, text\n\n"
    )
    base = profile.repo_profile(files, commits)
    overview = reports.basic_overview(base, files, contents.read_contents(important, files))
    sinks.write_overview_report(overview, str(tmp_path / "overview"))
    written = _text(str(tmp_path / "overview" / "repo_id=s"))
    assert written.startswith("# Project Overview (Basic Analysis)\n\n## Repository Information\n**URL**: Local repository\n**Primary Language**: Python\n**Total Files**: 3\n")
    assert "- **Python**: 5 lines (62.5%)\n- **Markdown**: 3 lines (37.5%)\n" in written and "- **Root directory**: 2 files\n- **src**: 1 files\n" in written
    assert "- **Total files analyzed**: 2/3\n" in written
    sinks.write_profile_json(base, str(tmp_path / "json"))
    assert json.loads(_text(str(tmp_path / "json")))["primary_language"] == "Python"
    assert json.loads(sinks.profile_json(base).first().json)["last_commit_date"] == "2024-01-02 10:00:00"


def test_overview_without_contents_and_languages(spark):
    files = spark.createDataFrame([("r", "data.bin", "x", 1)], "repo_id string, path string, content string, size bigint")
    commits = spark.createDataFrame([], schemas.COMMITS).drop("seq")
    base = profile.repo_profile(files, commits)
    row = reports.basic_overview(base, files).first()
    assert row.primary_language == "Unknown" and row.total_files_analyzed == 0
    assert "- No language information available" in row.overview and "File Analysis Summary" not in row.overview
    assert reports.language_summary_text(base).first().summary == "No programming languages detected."
    assert reports.repo_card(base).first().card.count("\n") == 8
    nothing = spark.createDataFrame([], schemas.IMPORTANT_FILES)
    assert reports.insights(base, nothing).first().insights == ["Average classification confidence: 0.0%"]
    assert reports.analysis_result(base, nothing).first().confidence_score == 0.0


def test_sample_lines_of_summary(spark):
    def summary(*samples):
        langs = [(f"L{i}", 100 - i, 1, 10.0, s) for i, s in enumerate(samples)]
        table = spark.createDataFrame([(langs, "L0")], f"languages {profile.LANGUAGES}, primary_language string").withColumn("repo_id", F.lit("r"))
        return [n for n, line in enumerate(reports.language_summary_text(table).first().summary.split("\n")) if line.startswith("  Sample")]

    assert summary(["a"], ["b"], ["c"], ["d"]) == [6, 8]
    assert summary([], ["b"], ["c"], ["d"]) == [7]
    assert summary([], [], ["c"], ["d"]) == [8]
    assert summary([], [], [], ["d"]) == []


def test_repository_has_no_large_or_foreign_files():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    listed = subprocess.run(["git", "ls-files"], cwd=root, capture_output=True, text=True).stdout.split()
    assert not [f for f in listed if f.endswith((".parquet", ".csv", ".orc"))]
