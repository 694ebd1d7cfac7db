"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import paths


def dedupe_repos(urls: DataFrame) -> DataFrame:
    """`(repo_key, id, url, addresses)`: one row per repository of `urls(id, url)`, keeping the lowest id."""
    keyed = urls.withColumn("repo_key", paths.normalize_repo_url("url"))
    return keyed.groupBy("repo_key").agg(
        F.min("id").alias("id"), F.min_by("url", "id").alias("url"), F.count("*").alias("addresses")
    )
