"""Important files: basic classification, levels, confidence, checks against the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths
from repoquarry.operators.skew import first_rows
from repoquarry.sources.tree import file_tree

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def level_rank(level: Column | str) -> Column:
    """1 for CRITICAL to 4 for LOW; null for anything else."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), paths.col(level))
    return F.when(rank > 0, rank.cast("int"))


def basic_class(path: Column | str) -> Column:
    """Struct (importance_level, content_type, reason) by substrings of the lower-cased path, first rule wins."""
    low = F.lower(paths.col(path))

    def answer(level: str, kind: str, reason: str) -> Column:
        return F.struct(F.lit(level).alias("importance_level"), F.lit(kind).alias("content_type"), F.lit(reason).alias("reason"))

    result = answer(*fixed.BASIC_DEFAULT)
    for level, kind, reason, words in reversed(fixed.BASIC_RULES):
        result = F.when(low.rlike(paths.any_of(words)), answer(level, kind, reason)).otherwise(result)
    return result


def classify_basic(files: DataFrame, n: int = fixed.BASIC_FILES) -> DataFrame:
    """Important files guessed from the names of the first n files of each repository."""
    first = first_rows(file_tree(files).select("repo_id", "path"), ["repo_id"], [F.asc("path")], n, "ordinal")
    classed = first.withColumn("class", basic_class("path"))
    return classed.select(
        "repo_id",
        F.col("path").alias("file_path"),
        "class.importance_level",
        F.lit(0.5).alias("confidence_score"),
        F.array("class.reason").alias("reasons"),
        "class.content_type",
        F.lit(100).alias("estimated_lines"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )


def existing_only(important: DataFrame, files: DataFrame) -> DataFrame:
    """Important files that occur in the tree."""
    return important.join(_tree_keys(files), ["repo_id", "file_path"], "left_semi")


def invented_paths(important: DataFrame, files: DataFrame) -> DataFrame:
    """Important files that do not occur in the tree."""
    return important.join(_tree_keys(files), ["repo_id", "file_path"], "left_anti")


def _tree_keys(files: DataFrame) -> DataFrame:
    return file_tree(files).select("repo_id", F.col("path").alias("file_path"))


def _level_count(level: str) -> Column:
    return F.count_if(F.col("importance_level") == level)


def importance_counts(important: DataFrame) -> DataFrame:
    """`(repo_id, critical, high, medium, low)`."""
    return important.groupBy("repo_id").agg(*[_level_count(level).alias(level.lower()) for level in LEVELS])


def avg_confidence(important: DataFrame) -> DataFrame:
    return important.groupBy("repo_id").agg(F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"))


def overall_confidence_of(average: Column, critical: Column) -> Column:
    """Mean confidence plus 0.1 for each critical file, at most 0.2 more and at most 1; 0 where there are no files."""
    bonus = F.least(critical * F.lit(0.1), F.lit(0.2))
    return F.coalesce(F.least(average + bonus, F.lit(1.0)), F.lit(0.0))


def overall_confidence(important: DataFrame) -> DataFrame:
    score = overall_confidence_of(F.avg("confidence_score"), _level_count("CRITICAL"))
    return important.groupBy("repo_id").agg(score.alias("confidence_score"))


def importance_stats(important: DataFrame) -> DataFrame:
    """Everything insights and recommendations need, in one aggregation."""
    has_config = F.lower("file_path").contains("config") | F.coalesce(F.lower("content_type").contains("config"), F.lit(False))
    return important.groupBy("repo_id").agg(
        F.count("*").alias("important_count"),
        *[_level_count(level).alias(level.lower()) for level in LEVELS],
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
        overall_confidence_of(F.avg("confidence_score"), _level_count("CRITICAL")).alias("confidence_score"),
        F.bool_or(has_config).alias("has_config"),
    )


def first_critical(important: DataFrame, n: int = 3) -> DataFrame:
    """`(repo_id, critical_paths)`: paths of the first n critical files in answer order."""
    critical = important.filter(F.col("importance_level") == "CRITICAL")
    head = first_rows(critical, ["repo_id"], [F.asc("ordinal"), F.asc("file_path")], n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "file_path")))
    return head.groupBy("repo_id").agg(ordered.alias("head")).select("repo_id", F.col("head.file_path").alias("critical_paths"))
