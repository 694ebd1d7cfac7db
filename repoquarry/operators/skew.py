"""Ways around hot groups: one repository, directory or set of equal files may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.session import cut_lineage


_GROUP_LIMIT = 1000
"""From this rank on Spark no longer cuts groups before the shuffle (`spark.sql.optimizer.windowGroupLimitThreshold`)."""


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group.

    The rank filter becomes a group limit before the shuffle, so at most n rows per group leave each task. For n from 1000 on, where
    Spark has no such limit, groups are first cut into slices by a hash of the row and each slice is reduced to its first n rows, so a
    hot group is never sorted in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if n >= _GROUP_LIMIT:
        slices = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(64))
        inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", slices).withColumn("_inside", F.row_number().over(inside)).filter(F.col("_inside") <= n).drop("_slice", "_inside")
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def spread_join(
    large: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "inner", rows_per_place: int = 1_000_000
) -> DataFrame:
    """Join whose large side may hold a third of its rows under one key.

    Keys with more than `rows_per_place` rows on the large side are counted; their rows are cut by the hash of `spread_by` into as many
    places as they need, and only for these keys the rows of the small side are repeated, once for each place. All other keys have
    one place and nothing of theirs is repeated. Nothing is dropped and the result is that of the plain join.
    """
    counted = large.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows_per_place)
    hot = counted.select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_place)).cast("int").alias("_places"))
    # At most one key for every `rows_per_place` rows of the table.
    one = F.coalesce("_places", F.lit(1))
    cut = large.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), one).cast("int")).drop("_places")
    repeated = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_places")
    return cut.join(repeated, [*keys, "_salt"], how).drop("_salt")


def rank_in_groups(df: DataFrame, keys: list[str], by: str, rank: str = "rank") -> DataFrame:
    """Exact 1..n rank of each row in its group, without sorting a group in one task.

    Rows are ordered by (md5(by), by). The leading hex digits of the hash cut a group into up to 4096 ordered slices
    of about equal size; a row's rank is its number inside its slice plus the rows in the slices before. Both come from
    the data alone, so a recomputed task gives the same ranks.
    """
    # The default keeps the join below from adding a condition on the slice to one of its two inputs' scans.
    slice_of = F.coalesce(F.left("_hash", F.lit(3)), F.lit(""))
    sliced = df.withColumn("_hash", F.md5(by)).withColumn("_slice", slice_of)
    slice_keys = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*slice_keys)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*slice_keys).orderBy("_hash", by)
    # A missing key is a group of its own.
    renamed = offsets.withColumnsRenamed({k: f"_of_{k}" for k in slice_keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in slice_keys]
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(renamed, same)
        .drop(*[f"_of_{k}" for k in slice_keys])
        .withColumn(rank, F.col("_offset") + F.col("_inside"))
        .drop("_hash", "_slice", "_inside", "_offset")
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to all tasks: a small file is few splits, however much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Exact 1..n place of each row of its group in the order of the columns, with no group in one task.

    All rows are sorted in ranges over the whole table, which cut a large group into many; a row's place in the table less the place of
    its group's first row gives its place in the group. The ranges are drawn from a sample, so the sorted rows are stored first. Groups
    that one task can sort are better numbered by a window.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_range").agg(F.count("*").alias("_rows"), F.min("_id").alias("_low"))  # one row per range
    starts = offsets.select("_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    placed = stored.join(F.broadcast(starts), "_range").withColumn("_place", F.col("_id") + F.col("_shift"))
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_range", "_id", "_shift", "_place", "_first")


def paged_lists(
    df: DataFrame, keys: list[str], order: list[str], value: Column, page_size: int, name: str, rows_per_group: int = 1_000_000
) -> DataFrame:
    """Groups as arrays sorted by `order`, in pages: `(keys, page, pages, name)`.

    Page p holds the places p * page_size + 1 up to (p + 1) * page_size, so the pages one after the other are the sorted group, whatever
    their size. Groups of up to `rows_per_group` rows are shuffled once by the keys, which numbers, counts and lists them; larger ones get
    their places from ranges, so no task or row holds a whole large group. Rows are shuffled as plain columns: the sorted entries
    are made where they are listed. Rows without a key are one page.
    """
    hot = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_group).dropna(subset=keys))
    group = Window.partitionBy(*keys)
    entry = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], value.alias("_value"))
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_value"]).alias(name)
    nameless = F.lit(False)
    for key in keys:
        nameless = nameless | F.col(key).isNull()
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    page = F.when(nameless, zero).otherwise(F.floor((F.col("_at") - 1) / F.lit(page_size)).cast("bigint")).alias("page")
    pages = F.when(nameless, one).otherwise(F.ceil(F.col("_n") / F.lit(page_size)).cast("bigint")).alias("pages")

    def paged(placed: DataFrame) -> DataFrame:
        return placed.groupBy(*keys, page).agg(F.max(pages).alias("pages"), listed)

    number, count = F.row_number().over(group.orderBy(*order)), F.count("*").over(group)
    numbered = lambda rows: paged(rows.withColumns({"_at": number, "_n": count}))
    if hot.isEmpty():
        return numbered(df)
    few = F.broadcast(hot)
    placed = ordinals(df.join(few.select(*keys), keys, "left_semi"), keys, order, "_at")
    return numbered(df.join(few, keys, "left_anti")).unionByName(paged(placed.join(few, keys)))
