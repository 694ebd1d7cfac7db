"""Exact vector retrieval that opens only the cells of vectors a query can need.

Unit vectors lie in cells around pivots; the distance between unit vectors falls as their cosine rises and obeys the triangle
inequality. A query first asks its nearest cells, as many as hold k chunks. The k-th best found there is a distance; a cell whose pivot is
farther than that plus the cell's radius holds nothing nearer and is never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.operators.chunks import _doubles, dot
from repoquarry.operators.skew import first_rows, spread_join
from repoquarry.session import cut_lineage

_SLACK = 1e-6
"""More than similarities move by rounding and by the last bits of a distance."""


def _unit(vector: Column | str) -> Column:
    """The vector with length one; null if it has none or holds what is no number."""
    values = _doubles(vector)
    length = F.sqrt(dot(values, values))
    return F.when((length > 0) & (length < F.lit(float("inf"))), F.transform(values, lambda x: x / length))


def _far(cosine: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))


def choose_pivots(chunks: DataFrame, per_repository: int = 16) -> DataFrame:
    """`(repo_id, cell, pivot)`: chunks picked by the hash of their id, a fixed number for each repository."""
    units = chunks.select("repo_id", "chunk_id", _unit("vector").alias("pivot")).filter("pivot is not null")
    picked = first_rows(units.withColumn("hash", F.xxhash64("chunk_id")), ["repo_id"], [F.asc("hash"), F.asc("chunk_id")], per_repository, "cell")
    return picked.select("repo_id", "cell", "pivot")


def _listed(pivots: DataFrame) -> DataFrame:
    """One row for each repository: its pivots as an array of a fixed number at most."""
    return pivots.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("cell", "pivot"))).alias("pivots"))


def cell_index(chunks: DataFrame, per_repository: int = 16) -> tuple[DataFrame, DataFrame]:
    """Chunks by cell `(repo_id, cell, chunk_id, vector, unit)` and cells `(repo_id, cell, pivot, radius, members)`, both stored.

    Every chunk with a direction lies in the cell of its nearest pivot.
    """
    pivots = cut_lineage(choose_pivots(chunks, per_repository))
    units = chunks.select("repo_id", "chunk_id", F.col("vector"), _unit("vector").alias("unit")).filter("unit is not null")
    joined = spread_join(units, _listed(pivots), ["repo_id"], "chunk_id")
    each = F.transform("pivots", lambda p: F.struct(_far(dot(p["pivot"], F.col("unit"))).alias("far"), p["cell"].alias("cell")))
    placed = joined.select("repo_id", "chunk_id", "vector", "unit", F.array_min(each).alias("home"))
    members = cut_lineage(placed.select("repo_id", F.col("home.cell").alias("cell"), "chunk_id", "vector", "unit", F.col("home.far").alias("far")))
    sizes = members.groupBy("repo_id", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("members"))
    return members.drop("far"), cut_lineage(pivots.join(sizes, ["repo_id", "cell"]))


def _asked_cells(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """`(repo_id, query_id, unit, cell, far, radius, first)`: cells seen from a query; `first` marks the nearest that hold k chunks."""
    units = queries.select("repo_id", "query_id", _unit("vector").alias("unit")).filter("unit is not null")
    seen = units.join(cells, "repo_id").withColumn("far", _far(dot("pivot", "unit")))
    nearer = Window.partitionBy("repo_id", "query_id").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("members").over(nearer), F.lit(0))
    return seen.select("repo_id", "query_id", "unit", "cell", "far", "radius", (held < k).alias("first"))


def _within(asked: DataFrame, members: DataFrame, digits: int) -> DataFrame:
    chunk = members.select("repo_id", "cell", "chunk_id", F.col("unit").alias("_unit"))
    met = spread_join(chunk, asked.select("repo_id", "cell", "query_id", "unit"), ["repo_id", "cell"], "chunk_id")
    return met.select("repo_id", "query_id", "chunk_id", F.round(dot("_unit", "unit"), digits).alias("similarity"))


def top_k_in_cells(queries: DataFrame, members: DataFrame, cells: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """`(repo_id, query_id, rank, chunk_id, similarity)`, equal to `top_k_similar`, and per query the cells opened
    `(repo_id, query_id, cells, opened)`."""
    asked = cut_lineage(_asked_cells(queries, cells, k))
    order = [F.desc("similarity"), F.asc("chunk_id")]
    near = cut_lineage(first_rows(_within(asked.filter("first"), members, digits), ["repo_id", "query_id"], order, k))
    reach = near.filter(F.col("rank") == k).select("repo_id", "query_id", F.col("similarity").alias("least"))
    rest = asked.filter("not first").join(reach, ["repo_id", "query_id"], "left")
    bound = F.greatest(F.lit(0.0), F.col("far") - F.col("radius"))
    # Without k chunks so far every cell may hold one.
    able = rest.filter(F.col("least").isNull() | (1 - bound * bound / 2 >= F.col("least") - _SLACK))
    more = _within(able, members, digits)
    found = near.select("repo_id", "query_id", "chunk_id", "similarity").unionByName(first_rows(more, ["repo_id", "query_id"], order, k).drop("rank"))
    opened = asked.filter("first").select("repo_id", "query_id", "cell").unionByName(able.select("repo_id", "query_id", "cell"))
    counts = asked.groupBy("repo_id", "query_id").agg(F.count("*").alias("cells"))
    visited = counts.join(opened.groupBy("repo_id", "query_id").agg(F.count("*").alias("opened")), ["repo_id", "query_id"])
    return first_rows(found, ["repo_id", "query_id"], order, k), visited
