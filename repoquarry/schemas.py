"""Declared schemas of the input tables as DDL text (nothing is inferred at read time)."""

from __future__ import annotations

REPOS = "repo_id string, url string, local_path string, branch string"
FILES = "repo_id string, path string, content string, size bigint, blob string"
COMMITS = (
    "repo_id string, commit_id string, author string, ts timestamp, message string, seq bigint"
)
FILE_CHANGES = (
    "repo_id string, commit_id string, file_path string, change_type string, old_path string, "
    "lines_added bigint, lines_deleted bigint, ts timestamp, parent_no int"
)
# One row per commit with its changes nested, as exports of a log write it.
COMMIT_EXPORT = (
    "repo_id string, commit_hash string, author string, date timestamp, message string, "
    "files_changed array<struct<file_path: string, change_type: string, old_path: string, "
    "lines_added: bigint, lines_deleted: bigint>>"
)
IMPORTANT_FILES = (
    "repo_id string, file_path string, importance_level string, confidence_score double, "
    "reasons array<string>, content_type string, estimated_lines bigint, ordinal bigint"
)
RESPONSES = "repo_id string, response_id string, text string"
LISTING = "repo_id string, root string, path string"
