"""Reading file trees.

`spark.read.format("binaryFile")` hides names starting with "_" or ".", which loses every `__init__.py`. So the
tree is listed and read through `pyarrow.fs`, which opens local, HDFS and object store addresses alike. The listing
is a table, so Spark spreads both the listing of directories and the reading of files over the cluster.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry import schemas
from repoquarry.functions import paths, text
from repoquarry.session import cut_lineage, ship

_BATCH = 2000  # listing rows handed back to Spark at a time
_BATCH_BYTES = 64 * 1024 * 1024  # file bytes handed back to Spark at a time
_COLUMNS = ["repo_id", "root", "path", "is_dir"]


class _Roots:
    """File systems of the roots a task meets, each opened once."""

    def __init__(self, skip: str | None):
        self.open: dict[str, tuple] = {}
        self.skip = re.compile(skip) if skip else None

    def of(self, root: str) -> tuple:
        from pyarrow import fs

        if root not in self.open:
            system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
            self.open[root] = system, base.rstrip("/")
        return self.open[root]

    def entries(self, root: str, sub: str) -> Iterator[tuple[str, bool]]:
        """(path relative to the root, is a directory) for what lies directly in root/sub and is not skipped."""
        from pyarrow import fs

        system, base = self.of(root)
        for info in system.get_file_info(fs.FileSelector(f"{base}/{sub}" if sub else base)):
            path = info.path[len(base) + 1 :]
            if not (self.skip and self.skip.search(path)):
                yield path, info.type == fs.FileType.Directory

    def files_below(self, root: str, sub: str) -> Iterator[str]:
        """Files below root/sub, holding one directory's entries at a time."""
        waiting = [sub]
        while waiting:
            for path, is_dir in self.entries(root, waiting.pop()):
                if is_dir:
                    waiting.append(path)
                else:
                    yield path


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while held := list(islice(rows, _BATCH)):
        yield pd.DataFrame(held, columns=columns)


def list_tree(repos: DataFrame, levels: int = 3, keep_ignored: bool = False) -> DataFrame:
    """Listing `(repo_id, root, path)` of every file below the roots in `repos(repo_id, root)`.

    The top `levels` levels are opened one by one with the found directories spread over the cluster in between; what
    lies deeper is walked by the task holding the directory. So one very large repository is listed by many tasks. Ignored
    folders are not opened, and files that are found pass no further Python.
    """
    skip = None if keep_ignored else paths.IGNORED_REGEX
    ship(repos.sparkSession)

    def one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = _Roots(skip)
        rows = (
            (repo_id, root, found, is_dir)
            for batch in batches
            for repo_id, root, path in batch[_COLUMNS[:3]].itertuples(index=False)
            for found, is_dir in roots.entries(root, path)
        )
        yield from _frames(rows, _COLUMNS)

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = _Roots(skip)
        rows = (
            (repo_id, root, found)
            for batch in batches
            for repo_id, root, path in batch[_COLUMNS[:3]].itertuples(index=False)
            for found in roots.files_below(root, path)
        )
        yield from _frames(rows, _COLUMNS[:3])

    found = []
    folders = repos.select("repo_id", "root", F.lit("").alias("path"))
    for _ in range(levels):
        # Stored, as files and folders of a level are read apart and no folder should be opened twice.
        level = cut_lineage(folders.mapInPandas(one_level, "repo_id string, root string, path string, is_dir boolean"))
        found.append(level.filter("not is_dir").select(*_COLUMNS[:3]))
        folders = level.filter("is_dir").select(*_COLUMNS[:3]).repartition("repo_id", "path")
    return reduce(DataFrame.unionByName, found, folders.mapInPandas(below, schemas.LISTING))


def scan_files(listing: DataFrame, keep_ignored: bool = False) -> DataFrame:
    """Canonical `files(repo_id, path, content, size, blob)` of a listing `(repo_id, root, path)`.

    A file that cannot be opened stays as a row with null content and blob. Ignored paths are dropped before anything is opened.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = _Roots(None)
        for batch in batches:
            rows, held = [], 0
            for repo_id, root, path in batch[["repo_id", "root", "path"]].itertuples(index=False):
                system, base = roots.of(root)
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    data = None
                blob = hashlib.md5(data).hexdigest() if data is not None else None
                rows.append((repo_id, path, data, len(data) if data is not None else 0, blob))
                held += len(data or b"")
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["repo_id", "path", "data", "size", "blob"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["repo_id", "path", "data", "size", "blob"])

    ship(listing.sparkSession)
    wanted = listing if keep_ignored else listing.filter(~paths.is_ignored("path"))
    raw = wanted.mapInPandas(read, "repo_id string, path string, data binary, size bigint, blob string")
    return raw.select("repo_id", "path", text.decode_text("data").alias("content"), "size", "blob")


def file_tree(files: DataFrame) -> DataFrame:
    """Non-ignored files as `(repo_id, path, dir, name)`; reads no content."""
    return files.filter(~paths.is_ignored("path")).select(
        "repo_id", "path", paths.parent_dir("path").alias("dir"), paths.file_name("path").alias("name")
    )
