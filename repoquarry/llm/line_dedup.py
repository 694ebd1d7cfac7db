"""Line dedup with levelled sorted runs of line hashes.

A run is a bucketed table of `(h1, h2, first_id)`, sorted by the hash in each bucket: the keys a batch of documents brought for
the first time, with the smallest document id that holds each. Batches go in order of document ids. Each new batch is reduced to
its distinct keys, merge-anti-joined with all runs (buckets meet without moving the runs again), and what is left becomes a run.
When a level is full its runs are merged into one run of the next level. So a key stands in exactly one run, with its owner, the
smallest id of all documents that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.llm.tables import bucketed, map_arrow, written
from repoquarry.llm.texts import slices

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LAST = (1 << 63) - 1
_HASH = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line in lower case (A-Z only); none if it has fewer than `min_chars` code points."""
    key = line.strip(_WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


class LineRuns:
    """The runs of one corpus. `fanout` runs of a level are merged into one of the next; `buckets` is the same for all runs."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = [[]]

    def _store(self, rows: DataFrame) -> str:
        return bucketed(rows, "lines", ["h1", "h2"], self.buckets)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Takes in a batch `(h1, h2, id)`: keys no run has yet become a run, with the smallest id of the batch.

        A hot key is one row per task before the shuffle and one row per batch behind it. An empty batch adds an empty run.
        """
        fresh = keys.groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
        for run in self.tables():
            fresh = fresh.join(run, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._store(fresh))
        for number, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if number + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[number + 1].append(self._store(self._all(level)))
                self._forget(level)
                self.levels[number] = []

    def _all(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")

    def owners(self) -> DataFrame:
        """All keys with their owners; one row per key."""
        return self._all([name for level in self.levels for name in level])

    def close(self) -> None:
        self._forget([name for level in self.levels for name in level])
        self.levels = [[]]


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """`(h1, h2, id)`: the distinct keys of each row. Rows without an id count as one document behind all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            ids, hashes = [], []
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for i, value in zip(batch.column(doc_id).to_pylist(), texts, strict=True):
                found = {line_key(line, min_chars) for line in (value or b"").split(b"\n")} - {None}
                hashes.extend(found)
                ids.extend([_LAST if i is None else i] * len(found))
            pairs = np.frombuffer(b"".join(hashes), _HASH)
            yield pa.RecordBatch.from_arrays([pa.array(pairs["h1"]), pa.array(pairs["h2"]), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias(doc_id), text), run, "h1 bigint, h2 bigint, id bigint")


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few MB of text."""
    sizes = pc.binary_length(batch.column("_row").field(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 3_000_000)) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, runs: LineRuns | None = None
) -> DataFrame:
    """All columns of `docs`, the text without repeated lines, `n_lines` (before) and `n_dropped`.

    Lines end at `\\n`; a null or empty text is one empty line and stays empty. A key (the line without white space at both ends, A-Z in
    lower case) of at least `min_chars` code points found in several documents loses all its lines except in the smallest id holding
    it; there all of them stay. Shorter lines always stay. Rows with the same id are one document. Columns named `n_lines` or
    `n_dropped` are replaced.

    `runs` may hold earlier batches of smaller ids; the new documents are then deduplicated against them too. Documents come in
    `batches` ranges of ids with about equally many keys. The owned keys of a document, never more than its lines, meet its text in
    one join on the document id.
    """
    spark = docs.sparkSession
    keys = written(line_keys(docs, doc_id, text, min_chars), "line-keys")
    held = runs or LineRuns(spark)
    share = [i / batches for i in range(1, batches)]
    bounds = sorted(set(keys.agg(F.percentile_approx("id", share, 1000)).first()[0] or [])) if share else []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = keys
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        held.add(part)
    hashed = F.struct("h1", "h2")
    owned = held.owners().groupBy("first_id").agg(F.collect_list(hashed).alias("_owned"))
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)).alias("first_id"))
    joined = whole.join(owned, "first_id", "left").select("_row", "_owned")
    schema = T.StructType(
        [
            T.StructField("_row", joined.schema["_row"].dataType),
            T.StructField("_text", T.StringType()),
            T.StructField("_lines", T.LongType()),
            T.StructField("_dropped", T.LongType()),
        ]
    )

    def keep(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in arrow for part in _parts(whole, text)):
            owned_lists = batch.column("_owned")
            flat = owned_lists.values
            pairs = np.empty(len(flat), _HASH)
            if len(flat):
                pairs["h1"], pairs["h2"] = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
            texts = batch.column("_row").field(text).cast(pa.binary()).to_pylist()
            kept_texts, n_lines, n_dropped = [], [], []
            for i, value in enumerate(texts):
                at = owned_lists.offsets[i].as_py(), owned_lists.offsets[i + 1].as_py()
                own = {p.tobytes() for p in pairs[at[0] : at[1]]} if owned_lists[i].is_valid else set()
                lines = (value or b"").split(b"\n")
                kept = [line for line in lines if (key := line_key(line, min_chars)) is None or key in own]
                kept_texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["_row", "_text", "_lines", "_dropped"],
            )

    result = map_arrow(joined, keep, schema)
    return result.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns],
        F.col("_lines").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
    )
