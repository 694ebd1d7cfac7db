"""Changes between two snapshots of the tree, and recomputing only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators.languages import enrich_files
from repoquarry.operators.renames import pair_changed
from repoquarry.operators.skew import rank_in_groups


def diff_snapshots(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`(repo_id, file_path, change_type, old_path, similarity)` leading from snapshot a to b, both `(repo_id, path, blob)`.

    M: same path, other blob. R: a removed and an added path with the same blob (similarity 1), paired one to one; of what these leave,
    if both snapshots have a column `content`, the pairs whose lines agree in `threshold` or more. What is left is A or D. Equal blobs may
    be very many (empty files), so pairs are made by a rank that needs no single sorted group.
    """
    changes = _by_blob(a, b).withColumn("similarity", F.when(F.col("change_type") == "R", F.lit(1.0)))
    if "content" not in a.columns or "content" not in b.columns:
        return changes
    return pair_changed(changes, a, b, threshold)


def _by_blob(a: DataFrame, b: DataFrame) -> DataFrame:
    tagged = a.select("repo_id", "path", "blob", F.lit(True).alias("in_a")).unionByName(
        b.select("repo_id", "path", "blob", F.lit(False).alias("in_a"))
    )
    # Grouping instead of a full join: conditions on the result cannot be pushed below the aggregation, so the parts
    # further down read one and the same shuffle of the snapshots instead of shuffling them again each.
    both = tagged.groupBy("repo_id", "path").agg(
        F.max(F.when(F.col("in_a"), F.col("blob"))).alias("blob_a"),
        F.max(F.when(~F.col("in_a"), F.col("blob"))).alias("blob_b"),
        F.bool_or("in_a").alias("in_a"),
        F.bool_or(~F.col("in_a")).alias("in_b"),
    ).filter("not (in_a and in_b and blob_a <=> blob_b)")
    modified = both.filter("in_a and in_b").select(
        "repo_id", F.col("path").alias("file_path"), F.lit("M").alias("change_type"), F.lit(None).cast("string").alias("old_path")
    )
    one_sided = both.filter("not (in_a and in_b)").select(
        "repo_id",
        "path",
        F.when(F.col("in_a"), "D").otherwise("A").alias("side"),
        F.coalesce("blob_a", "blob_b").alias("blob"),
    )
    # Files without a readable blob can never be matched; they pass through as they are.
    blind = one_sided.filter("blob is null").select(
        "repo_id", F.col("path").alias("file_path"), F.col("side").alias("change_type"), F.lit(None).cast("string").alias("old_path")
    )
    ranked = rank_in_groups(one_sided.filter("blob is not null"), ["repo_id", "blob", "side"], "path")
    paired = ranked.groupBy("repo_id", "blob", "rank").agg(
        F.max(F.when(F.col("side") == "D", F.col("path"))).alias("gone"),
        F.max(F.when(F.col("side") == "A", F.col("path"))).alias("new"),
    )
    moved = paired.select(
        "repo_id",
        F.coalesce("new", "gone").alias("file_path"),
        F.expr("case when new is null then 'D' when gone is null then 'A' else 'R' end").alias("change_type"),
        F.expr("case when new is not null then gone end").alias("old_path"),
    )
    return modified.unionByName(moved).unionByName(blind)


def file_stats(files: DataFrame) -> DataFrame:
    """What an incremental profile keeps per file: the enriched table, which profiles take in place of `files`."""
    return enrich_files(files)


def incremental_stats(previous: DataFrame, files: DataFrame) -> DataFrame:
    """`file_stats(files)`, taking unchanged files from the previous table; `repo_profile` takes it in place of `files`.

    Only files whose (path, blob) is new have their content counted. The snapshot is matched on narrow columns; the
    wide scan is then reduced to the changed keys.
    """
    keys = ["repo_id", "path", "blob"]
    current = files.select(*keys)
    unchanged = previous.join(current, keys, "left_semi")
    changed = current.join(previous.select(*keys), keys, "left_anti").select("repo_id", "path")
    fresh = files.join(changed, ["repo_id", "path"], "left_semi")
    return unchanged.unionByName(file_stats(fresh)).select(*previous.columns)
