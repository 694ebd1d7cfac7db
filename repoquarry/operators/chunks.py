"""Overlapping text chunks and vector retrieval over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import paths
from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import first_rows, spread_join


def chunk_text(files: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """`(repo_id, path, language, chunk_no, start, chunk)`: pieces of `size` characters, each repeating `overlap`.

    The text is cut once into steps of size - overlap; a chunk is a step plus the head of the next, so the work is
    linear in the text. A last step that only repeats the overlap of the chunk before is no chunk.
    """
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must lie between 0 and half the chunk size")
    step = size - overlap
    cut = files.filter(F.length("content") > 0).select(
        "repo_id",
        "path",
        paths.language_of("path").alias("language"),
        F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)).alias("steps"),
    )
    steps = F.col("steps")

    def chunk(piece: Column, i: Column) -> Column:
        following = F.coalesce(F.try_element_at(steps, i + 2), F.lit(""))
        return F.concat(piece, F.left(following, F.lit(overlap)))

    count = F.when(
        (F.size(steps) > 1) & (F.length(F.element_at(steps, -1)) <= overlap), F.size(steps) - 1
    ).otherwise(F.size(steps))
    chunks = cut.withColumn("chunks", F.slice(F.transform(steps, chunk), F.lit(1), count))
    rows = unfold(chunks, ["repo_id", "path", "language"], F.col("chunks"), "chunk", "chunk_no")
    return rows.select(
        "repo_id", "path", "language", "chunk_no", (F.col("chunk_no") * step + 1).alias("start"), "chunk"
    )


SEPARATORS = ("\n\n", "\n", " ")
"""Paragraphs, lines, words."""


def split_recursive(files: DataFrame, size: int = 2000, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """`(repo_id, path, language, chunk_no, start, chunk)`: chunks of at most `size` characters that keep paragraphs, lines and words whole.

    A text longer than a chunk is cut behind every separator of the first level; a piece that is still longer at the next one, and what
    no separator cuts at `size` characters. Neighbouring pieces then fill chunks one after the other. Nothing is lost, doubled or trimmed: the chunks of a
    text one after the other are the text. Empty and null texts have none. A text is folded inside its row.
    """
    pieces = F.array("content")
    for separator in separators:
        behind = rf"(?s).*?(?:{re.escape(separator)}|\z)"
        pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(behind), F.lit(0)))))  # noqa: B023
    fixed = F.lit(rf"(?s).{{1,{size}}}")
    pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.regexp_extract_all(p, fixed, F.lit(0)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("chunk"))

    def fill(state: Column, piece: Column) -> Column:
        fits = F.length(state["chunk"]) + F.length(piece) <= size
        done = F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["chunk"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["chunk"], piece)).otherwise(piece).alias("chunk"))

    chunks = F.aggregate(pieces, start, fill, lambda state: F.filter(F.array_append(state["done"], state["chunk"]), lambda c: c != ""))
    texts = files.filter(F.length("content") > 0)
    rows = unfold(texts, ["repo_id", "path", paths.language_of("path").alias("language")], _with_starts(chunks), "cut", "chunk_no")
    return rows.select("repo_id", "path", "language", "chunk_no", "cut.start", "cut.chunk")


def _with_starts(chunks: Column) -> Column:
    """Chunks with the place of their first character, from 1."""
    none = F.array().cast("array<struct<start: bigint, chunk: string>>")
    start = F.struct(F.lit(1).cast("bigint").alias("at"), none.alias("found"))

    def step(state: Column, chunk: Column) -> Column:
        found = F.array_append(state["found"], F.struct(state["at"].alias("start"), chunk.alias("chunk")))
        return F.struct((state["at"] + F.length(chunk)).alias("at"), found.alias("found"))

    return F.aggregate(chunks, start, step, lambda state: state["found"])


def _doubles(vector: Column | str) -> Column:
    return paths.col(vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def top_k_similar(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """`(repo_id, query_id, rank, chunk_id, similarity)`: exact cosine top k among the chunks of the query's repository.

    Chunks `(repo_id, chunk_id, vector)`, queries `(repo_id, query_id, vector)`. Norms are taken once per vector, and at
    most k candidates per query leave each task. Similarities are rounded before ranking, ties go to the lower chunk id.
    """
    left = chunks.select("repo_id", "chunk_id", _doubles("vector").alias("cv")).withColumn(
        "cn", F.sqrt(dot(F.col("cv"), F.col("cv")))
    )
    right = queries.select("repo_id", "query_id", _doubles("vector").alias("qv")).withColumn(
        "qn", F.sqrt(dot(F.col("qv"), F.col("qv")))
    )
    similarity = F.round(F.try_divide(dot(F.col("cv"), F.col("qv")), F.col("cn") * F.col("qn")), digits)
    scored = spread_join(left, right, ["repo_id"], "chunk_id").select("repo_id", "query_id", "chunk_id", similarity.alias("similarity"))
    return first_rows(
        scored.filter(F.col("similarity").isNotNull()),
        ["repo_id", "query_id"],
        [F.desc("similarity"), F.asc("chunk_id")],
        k,
    )


def centroids(vectors: DataFrame) -> DataFrame:
    """`(repo_id, vector)`: mean vector per repository, aggregated per position."""
    positions = vectors.select("repo_id", F.posexplode(_doubles("vector")).alias("i", "x"))
    means = positions.groupBy("repo_id", "i").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))  # one entry per dimension
    return means.groupBy("repo_id").agg(ordered.alias("dims")).select("repo_id", F.col("dims.x").alias("vector"))
