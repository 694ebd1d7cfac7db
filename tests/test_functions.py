from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from repoquarry.functions import paths, text


def evaluate(spark, values, build, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_line_counts(spark):
    values = ["a\nb\n", "a\nb", "", "\n", "a\r\nb\rc", "a\n\n"]
    assert evaluate(spark, values, text.line_count) == [2, 2, 0, 1, 3, 2]
    assert evaluate(spark, values, text.split_line_count) == [3, 2, 1, 2, 3, 3]


def test_path_parts_follow_pathlib(spark):
    values = ["a.tar.gz", ".bashrc", "x.", "src/a.PY", "a/b.c/d", "..a", "dir/.env.local", "README", "a/b/c.d.e"]
    assert evaluate(spark, values, paths.suffix) == [pathlib.PurePosixPath(v).suffix if not v.endswith(".") else "" for v in values]
    assert evaluate(spark, values, paths.parent_dir) == [str(pathlib.PurePosixPath(v).parent) for v in values]
    assert evaluate(spark, values, paths.file_name) == [pathlib.PurePosixPath(v).name for v in values]
    assert evaluate(spark, values, paths.stem)[:2] == ["a.tar", ".bashrc"]


def test_ignored(spark):
    out = [".git", "__pycache__", ".DS_Store", "node_modules", "a/node_modules/b.js", "src/.hidden/x.py", "a/*.log", "x/__pycache__/y"]
    kept = ["main.py", "README.md", "my__pycache__/a", "a/node_modules2/b", "debug.log", "a.b/c"]
    assert all(evaluate(spark, out, paths.is_ignored))
    assert not any(evaluate(spark, kept, paths.is_ignored))


def test_language_and_lists(spark):
    assert evaluate(spark, ["a.py", "A.PY", "a.tsx", "a.pyi", "x"], paths.language_of) == ["Python", "Python", "TSX", None, None]
    assert evaluate(spark, ["a.tsx", "a.pyi", "a.less"], paths.listed_languages) == [["TypeScript", "React"], ["Python"], None]


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://github.com/owner/repo.git", "github_com_owner_repo"),
        ("git@github.com:owner/repo.git", "github_com_owner_repo"),
        ("HTTP://Host/A-B.GIT", "host_a_b"),
        ("ssh://git@h/r", "ssh:__git@h_r"),
        ("https://h/r.git/", "h_r_git_"),
    ],
)
def test_normalize_url(spark, url, key):
    assert evaluate(spark, [url], paths.normalize_repo_url) == [key]


def test_local_paths(spark):
    values = ["/local/path", "./relative/path", "../parent/path", "https://x/y", "http://x/y", "git@x:y", "ssh://x/y"]
    assert evaluate(spark, values, paths.is_local_path) == [True] * 3 + [False] * 4


def test_strip_matches_python(spark):
    values = ["  a b \n", "\t\x1c x  ", "", "\n \n", "a\n\n", "\u0085z"]
    assert evaluate(spark, values, text.strip_text) == [v.strip() for v in values]


def test_truncate(spark):
    values = ["a\nb\nc", "a\nb", "a\nb\n", "a\r\nb\r\nc\r\nd"]
    mark = "\n\n... (truncated, showing first 2 lines)"
    assert evaluate(spark, values, lambda v: text.truncate_lines(v, 2)) == ["a\nb" + mark, "a\nb", "a\nb" + mark, "a\nb" + mark]
    assert evaluate(spark, values, lambda v: text.truncated_line_count(v, 2)) == [2, 2, 2, 2]


def test_decode_replaces_invalid_bytes(spark):
    values = [bytearray("é".encode()), bytearray(b"a\xffb"), None]
    assert evaluate(spark, values, text.decode_text, "binary") == ["é", "a�b", None]


def test_description(spark):
    values = ["# T\n\nOne\nTwo\nThree\nFour", "# only\n## headings", "x" * 600, "\n" * 10 + "late"]
    assert evaluate(spark, values, text.description_of) == ["One Two Three", "", "x" * 500, ""]


def test_headline_and_hash(spark):
    assert evaluate(spark, ["first\nsecond", "y" * 100], text.message_headline) == ["first", "y" * 80]
    assert evaluate(spark, ["0123456789ab"], text.short_hash) == ["01234567"]


def test_full_path_and_ancestors(spark):
    df = spark.createDataFrame([(".", "a"), ("x/y", "b")], "d string, n string")
    assert [r[0] for r in df.select(paths.full_path("d", "n")).collect()] == ["a", "x/y/b"]
    assert evaluate(spark, ["a/b/c.py", "c.py"], paths.ancestor_dirs) == [["a", "a/b"], []]
