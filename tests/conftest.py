from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repoquarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample(spark):
    """A repository of three files and two commits: (files, commits, changes)."""
    files = spark.createDataFrame(
        [
            ("s", "README.md", "# Sample Repository\n\nThis is a test repository."),
            ("s", "main.py", "print('hello')\n\n# Added comment\n"),
            ("s", "src/module.py", "def f():\n    pass\n"),
            ("s", ".git/config", "x\n"),
        ],
        "repo_id string, path string, content string",
    ).selectExpr("*", "cast(length(content) as bigint) as size", "md5(content) as blob")
    commits = spark.createDataFrame(
        [("s", "c1", "Ann", "2024-01-01 10:00:00", "Initial commit\n"), ("s", "c2", "Bob", "2024-01-02 10:00:00", "Added comment to main.py")],
        "repo_id string, commit_id string, author string, ts string, message string",
    ).selectExpr("repo_id", "commit_id", "author", "cast(ts as timestamp) as ts", "message")
    changes = spark.createDataFrame(
        [
            ("s", "c1", "README.md", "A", None, 3, 0),
            ("s", "c1", "main.py", "A", None, 1, 0),
            ("s", "c1", "src/module.py", "A", None, 2, 0),
            ("s", "c2", "main.py", "M", None, 2, 0),
        ],
        "repo_id string, commit_id string, file_path string, change_type string, old_path string, lines_added bigint, lines_deleted bigint",
    )
    return files, commits, changes


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
