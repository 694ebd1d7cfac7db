"""Nearest neighbours with vantage-point trees: one over cells of vectors, one in each shard of a cell.

A bounded sample is split again and again at the median distance from a vantage point; its leaves are the cells, and every vector goes down
to one of them. Cells larger than a shard are dealt into several by the hash of the id. A query first searches the cell it falls into itself.
The distance of the k-th it finds there tells, by the triangle inequality, which other cells can hold a nearer one: those whose
bound times `factor` is not above it, and only to them it is sent. Inside a shard the same rule skips halves of the shard's own tree.
Factor one loses nothing, larger factors skip more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.llm.tables import map_arrow, ship, written

LEAF = 128
_SLACK = 1e-12
"""More than the share by which rounding moves a distance."""
_BLOCK = 2_000_000
"""Numbers in a block of differences."""


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    result = np.empty((len(queries), len(points)))
    step = max(1, _BLOCK // max(1, points.size))
    for at in range(0, len(queries), step):
        difference = queries[at : at + step, None, :] - points[None]
        result[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", difference, difference))
    return result


class Tree:
    """Vantage-point tree of one shard. Equal distances do not part, so many equal vectors are one leaf."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = self.points[rows[len(rows) // 2]]
        far = distances(self.points[rows], vantage[None])[:, 0]
        cut = np.median(far)
        inner = far <= cut
        if inner.all():
            inner = far < cut
            if not inner.any():
                return rows
        halves = []
        for part in (inner, ~inner):
            halves.append((far[part].min(), far[part].max(), self._build(rows[part])))
        return vantage, halves

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query (infinite and -1: none), nearest first, ties by id; not its own id.

        What lies farther than `within`, if given, need not be found.
        """
        reach = np.full(len(queries), np.inf) if within is None else within
        near = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), -1, np.int64)

        def visit(node, asked: np.ndarray) -> None:
            if not len(asked):
                return
            if isinstance(node, np.ndarray):
                found = distances(queries[asked], self.points[node])
                ids = np.broadcast_to(self.ids[node], found.shape)
                found = np.where(ids == own[asked, None], np.inf, found)
                if found.shape[1] > k:  # all that tie with the k-th stay for the choice by id
                    last = np.partition(found, k - 1, axis=1)[:, k - 1]
                    width = int((found <= last[:, None]).sum(1).max())
                    pick = np.lexsort((ids, found), axis=1)[:, : min(width, k)]
                    found, ids = np.take_along_axis(found, pick, 1), np.take_along_axis(ids, pick, 1)
                all_d = np.concatenate((near[asked], found), axis=1)
                all_i = np.concatenate((who[asked], np.where(np.isinf(found), -1, ids)), axis=1)
                pick = np.lexsort((all_i, all_d), axis=1)[:, :k]
                near[asked], who[asked] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_i, pick, 1)
                return
            vantage, halves = node
            far = distances(queries[asked], vantage[None])[:, 0]
            # A computed bound may pass the distance it bounds by its last bits.
            bounds = np.array([np.maximum(0, np.maximum(far - high, low - far) - _SLACK * (far + high)) for low, high, _ in halves])
            first = bounds[0] <= bounds[1]
            for turn in (0, 1):
                for side, group in ((0, first if turn == 0 else ~first), (1, ~first if turn == 0 else first)):
                    chosen = asked[group]
                    visit(halves[side][2], chosen[bounds[side][group] * factor <= np.minimum(near[chosen, -1], reach[chosen])])

        if len(self.points):
            visit(self.root, np.arange(len(queries)))
        return near, who


class Cells:
    """Vantage-point tree over a sample, whose leaves are cells. The inner half of a node lies within its cut, the outer beyond."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.count = 0
        self.root = self._build(sample, leaves)

    def _build(self, points: np.ndarray, leaves: int):
        if leaves > 1 and len(points) > 1:
            vantage = points[len(points) // 2]
            far = distances(points, vantage[None])[:, 0]
            cut = np.median(far)
            inner = far <= cut
            if not inner.all():
                return vantage, cut, self._build(points[inner], leaves // 2), self._build(points[~inner], leaves - leaves // 2)
        self.count += 1
        return self.count - 1

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        cells = np.zeros(len(points), np.int32)

        def down(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                cells[rows] = node
            elif len(rows):
                vantage, cut, inner, outer = node
                near = distances(points[rows], vantage[None])[:, 0] <= cut
                down(inner, rows[near])
                down(outer, rows[~near])

        down(self.root, np.arange(len(points)))
        return cells

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """For each vector and cell a distance that no vector of the cell is nearer than."""
        result = np.zeros((len(points), self.count))

        def down(node, least: np.ndarray) -> None:
            if isinstance(node, int):
                result[:, node] = least
                return
            vantage, cut, inner, outer = node
            far = distances(points, vantage[None])[:, 0]
            slack = _SLACK * (far + cut)
            down(inner, np.maximum(least, far - cut - slack))
            down(outer, np.maximum(least, cut - far - slack))

        down(self.root, np.zeros(len(points)))
        return result


def usable(vector: Column) -> Column:
    """Vectors that are not null, not zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The vectors of a batch by their length."""
    for size in pc.unique(batch.column("size")).to_pylist():
        yield size, batch.filter(pc.equal(batch.column("size"), size))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    factor: float = 1.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 5_000,
    block_queries: int = 20_000,
    sample_rows: int = 20_000,
    most_cells: int = 256,
) -> DataFrame:
    """The k nearest other vectors of every row that is a query: `(query_id, rank, vec_id, score)`, the score the Euclidean distance.

    Every usable row is searched; only vectors of the query's length are compared. Rows of equal id count once, with the smallest of their
    vectors of a length; a row without an id takes no part. Fewer than k candidates give fewer rows, no queries none. Only the cells are fitted, on
    at most `sample_rows` vectors; there are at most `most_cells` of a length and as many trees as lengths among the sample. A task
    holds one shard and one block of queries, of the sizes given, whatever the size of the table.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v"))
    total, different = rows.agg(F.count("*"), F.count_distinct("id", "size")).first()
    if different < total:
        rows = rows.groupBy("id", "size").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks")).select("id", "v", "asks", "size")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("size", "v").toArrow()
    trees: dict[int, Cells] = {}
    for size in pc.unique(sample.column("size")).to_pylist():
        points = _matrix(sample.filter(pc.equal(sample.column("size"), size)).column("v"), size)
        share = total * len(points) // max(1, sample.num_rows)
        trees[size] = Cells(points, max(1, min(most_cells, share // shard_rows, len(points) // 16)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                cells = trees[size].place(_matrix(part.column("v"), size)) if size in trees else np.zeros(part.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells)], [*part.schema.names, "cell"])

    placed = written(map_arrow(rows, place, "id bigint, v array<double>, asks boolean, size int, cell int"), "placed-vectors")
    # One row for each cell of a length.
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))

    def spread(n: str, name: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int").alias(name)

    def each(n: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    def search(table: pa.Table) -> pa.Table:
        width = table.column("size")[0].as_py()
        sides = []
        for flag in (False, True):
            part = table.filter(pc.equal(table.column("asks"), flag)).combine_chunks()
            sides.append((part.column("id").to_numpy(), _matrix(part.column("v"), width), part.column("reach").to_numpy()))
        (ids, points, _), (own, queries, reach) = sides
        near, who = Tree(points, ids).search(queries, own, k, factor, reach)
        found = ~np.isinf(near)
        return pa.table({"query_id": np.repeat(own, k)[found.ravel()], "vec_id": who[found], "score": near[found]})

    def searched(asking: DataFrame) -> DataFrame:
        """What the queries `(id, v, size, cell, reach)` find in the cells."""
        columns = ["id", "v", "size", "cell", "asks", "reach", "part", "block"]
        blocks = asking.groupBy("size", "cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
        many = parts.join(blocks, ["size", "cell"])
        held = placed.join(many, ["size", "cell"]).select("id", "v", "size", "cell", F.lit(False).alias("asks"), F.lit(float("inf")).alias("reach"), spread("parts", "part", 1), each("blocks", "block"))
        sent = asking.join(many, ["size", "cell"]).select("id", "v", "size", "cell", F.lit(True).alias("asks"), "reach", each("parts", "part"), spread("blocks", "block", 2))
        both = held.select(*columns).unionByName(sent.select(*columns))
        return both.groupBy("size", "cell", "part", "block").applyInArrow(search, "query_id bigint, vec_id bigint, score double")

    ship(vectors.sparkSession)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    queries = placed.filter("asks")
    home = searched(queries.select("id", "v", "size", "cell", F.lit(float("inf")).alias("reach")))
    first = written(home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first-neighbours")
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reach"))
    going = queries.join(reached, "id", "left").select("id", "v", "size", "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                if size not in trees:
                    continue
                bounds = trees[size].bounds(_matrix(part.column("v"), size))
                able = bounds * factor <= part.column("reach").to_numpy()[:, None]
                able[np.arange(part.num_rows), part.column("cell").to_numpy()] = False
                query, cell = np.nonzero(able)
                chosen = part.take(pa.array(query))
                names = ["id", "v", "size", "reach"]
                yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in names), pa.array(cell.astype(np.int32))], [*names, "cell"])

    more = searched(map_arrow(going, others, "id bigint, v array<double>, size int, reach double, cell int"))
    found = first.select("query_id", "vec_id", "score").unionByName(more)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
