"""File trees as a Spark data source: `spark.read.format("repo_tree").load(root)`.

The root holds one folder for each repository. The folders of the top levels are listed when the read is planned; each of them is a
partition of its own, and what lies deeper is walked by the task that reads it. Filters on `repo_id` and on the beginning of `path` are
pushed down, so other folders are not even listed, and ignored ones never are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from repoquarry.functions import paths, text
from repoquarry.session import ship
from repoquarry.sources.tree import _Roots

FORMAT = "repo_tree"
_BATCH_BYTES = 64 * 1024 * 1024  # file bytes handed to Spark at a time
_BATCH_FILES = 2000
_ARROW = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("data", pa.binary()), ("size", pa.int64()), ("blob", pa.string())])


@dataclass
class Folder(InputPartition):
    """A folder of a repository, with all below it or only the files right in it."""

    repo_id: str
    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.levels = int(options.get("levels", 2))
        self.contents = options.get("contents", "true").lower() == "true"
        self.skip = None if options.get("ignored", "false").lower() == "true" else paths.IGNORED_REGEX
        self.repositories: set[str] | None = None
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("repo_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.repositories = named if self.repositories is None else self.repositories & named
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.beginnings.append(f.value)
            else:
                yield f

    def _wanted(self, path: str, folder: bool) -> bool:
        """Whether the file, or anything in the folder, begins as asked."""
        return all(path.startswith(b) or folder and b.startswith(f"{path}/") for b in self.beginnings)

    def partitions(self) -> list[Folder]:
        roots = _Roots(None)
        names = [path for path, is_dir in roots.entries(self.root, "") if is_dir]
        found: list[Folder] = []
        for repo in sorted(names):
            if self.repositories is not None and repo not in self.repositories:
                continue
            level, inside = [""], _Roots(self.skip)
            for _ in range(self.levels):
                found += [Folder(repo, sub, False) for sub in level]
                level = [p for sub in level for p, is_dir in inside.entries(f"{self.root}/{repo}", sub) if is_dir and self._wanted(p, True)]
            found += [Folder(repo, sub, True) for sub in level]
        return found

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        roots, top = _Roots(self.skip), f"{self.root}/{partition.repo_id}"
        system, base = roots.of(top)
        if partition.deep:
            listed = roots.files_below(top, partition.path)
        else:
            listed = (path for path, is_dir in roots.entries(top, partition.path) if not is_dir)
        rows, held = [], 0
        for path in listed:
            if not self._wanted(path, False):
                continue
            data = None
            if self.contents:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    data = None
            rows.append((partition.repo_id, path, data, len(data or b""), hashlib.md5(data).hexdigest() if data is not None else None))
            held += len(data or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_FILES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class TreeSource(DataSource):
    """Options: `levels` listed when planning (2), `contents` read (true), `ignored` files too (false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "repo_id string, path string, data binary, size bigint, blob string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def read_trees(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Canonical `files(repo_id, path, content, size, blob)` of all repositories below the root.

    A file that cannot be opened, and every file if contents are not wanted, has a null content and blob.
    """
    register(spark)
    raw = spark.read.format(FORMAT).options(**options).load(root)
    return raw.select("repo_id", "path", text.decode_text("data").alias("content"), "size", "blob")


def write_trees(files: DataFrame, root: str) -> None:
    """Writes `files(repo_id, path, content)` as trees `root/repo_id/path`, for files with a content. Tasks that run again write the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _Roots(None).of(root)
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{base}/{row['repo_id']}/{row['path']}"
                if re.search(r"(^|/)[.][.]?(/|$)", row["path"]):
                    raise ValueError(f"not a path inside a tree: {row['path']}")
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(row["content"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    ship(files.sparkSession)
    files.filter("content is not null").select("repo_id", "path", "content").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
