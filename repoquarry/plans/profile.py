"""One row per repository, joined from per-repository aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths, text
from repoquarry.operators import history, languages

LANGUAGES = (
    "array<struct<language: string, line_count: bigint, file_count: bigint, percentage: double, "
    "sample_files: array<string>>>"
)


def repo_description(files: DataFrame) -> DataFrame:
    """`(repo_id, repo_description)` from the best root README; takes `files` or the enriched table."""
    if "description" not in files.columns:
        files = files.withColumn("description", text.description_of("content"))
    names = F.array(*map(F.lit, fixed.README_NAMES))
    # At most four candidate rows per repository.
    candidates = files.filter(F.col("path").isin(fixed.README_NAMES))
    best = F.min_by("description", F.array_position(names, F.col("path")))
    return candidates.groupBy("repo_id").agg(best.alias("repo_description"))


def content_facts(files: DataFrame) -> DataFrame:
    """`(repo_id, lines array<struct<language, line_count>>, total_files, repo_description)` in one pass over contents.

    Lines and files are summed per (repository, language) in each task, so what meets per repository is one row per
    known language and up to four READMEs.
    """
    counted = ~paths.is_ignored("path")
    if "line_count" not in files.columns:
        files = files.withColumns(
            {
                "line_count": text.line_count("content"),
                "description": F.when(F.col("path").isin(fixed.README_NAMES), text.description_of("content")),
            }
        )
    rank = F.array_position(F.array(*map(F.lit, fixed.README_NAMES)), F.col("path"))
    readme = F.when(F.col("path").isin(fixed.README_NAMES), F.struct(rank.alias("rank"), "description"))
    per_language = (
        files.groupBy("repo_id", paths.language_of("path").alias("language"))
        .agg(
            F.sum(F.when(counted, F.col("line_count"))).alias("line_count"),
            F.count_if(counted).alias("files"),
            F.collect_list(readme).alias("readmes"),
        )
    )
    has_lines = F.col("language").isNotNull() & F.col("line_count").isNotNull()
    per_repo = per_language.groupBy("repo_id").agg(
        F.collect_list(F.when(has_lines, F.struct("language", "line_count"))).alias("lines"),
        F.sum("files").alias("total_files"),
        F.sort_array(F.flatten(F.collect_list("readmes"))).alias("readmes"),
    )
    best = F.try_element_at("readmes", F.lit(1))["description"]
    return per_repo.select("repo_id", "lines", "total_files", best.alias("repo_description"))


def file_facts(files: DataFrame) -> DataFrame:
    """`(repo_id, listed map<language, struct<file_count, sample_files>>)` from paths alone."""
    both = languages.file_counts(files).join(languages.sample_files(files), ["repo_id", "language"])
    entries = F.collect_list(F.struct("language", F.struct("file_count", "sample_files")))
    return both.groupBy("repo_id").agg(F.map_from_entries(entries).alias("listed"))


def _language_array() -> Column:
    """The language table of a repository as an array by lines, from its content and file facts."""
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda t, e: t + e["line_count"])
    ordered = F.sort_array(F.transform("lines", lambda e: F.struct((-e["line_count"]).alias("neg"), e["language"].alias("language"))))

    def entry(e: Column) -> Column:
        listed = F.try_element_at("listed", e["language"])
        share = F.try_divide((-e["neg"]).cast("double"), total.cast("double")) * 100
        return F.struct(
            e["language"].alias("language"),
            (-e["neg"]).alias("line_count"),
            F.coalesce(listed["file_count"], F.lit(0).cast("bigint")).alias("file_count"),
            F.coalesce(share, F.lit(0.0)).alias("percentage"),
            F.coalesce(listed["sample_files"], F.array().cast("array<string>")).alias("sample_files"),
        )

    return F.transform(ordered, entry)


def repo_ids(*tables: DataFrame) -> DataFrame:
    """Distinct repositories of all tables; each table is reduced before they meet."""
    return reduce(DataFrame.unionByName, [t.select("repo_id").distinct() for t in tables]).distinct()


def repo_profile(files: DataFrame, commits: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The wide profile of each repository.

    All joins are on `repo_id` between tables with one row per repository, so a large repository weighs no more than a
    small one. Contents are read once; with the enriched table in place of `files` they are not read at all.
    """
    if repos is None:
        nothing = {c: F.lit(None).cast("string") for c in ("url", "local_path", "branch")}
        base = repo_ids(files, commits).withColumns(nothing)
    else:
        base = repos.select("repo_id", "url", "local_path", "branch")
    parts = [content_facts(files), file_facts(files), history.commit_overview(commits), history.recent_authors(commits)]
    joined = reduce(lambda left, right: left.join(right, "repo_id", "left"), parts, base)
    joined = joined.withColumn("languages", F.coalesce(_language_array(), F.array().cast(LANGUAGES)))
    primary = F.try_element_at("languages", F.lit(1))["language"]
    zero = F.lit(0).cast("bigint")
    # An address if there is one, else where the repository lies.
    return joined.select(
        "repo_id",
        F.coalesce("url", "local_path").alias("repo_url"),
        "local_path",
        F.coalesce("branch", text.short_hash("last_commit")).alias("branch"),
        "repo_description",
        "languages",
        F.coalesce(primary, F.lit("Unknown")).alias("primary_language"),
        F.coalesce("total_files", zero).alias("total_files"),
        F.coalesce("total_commits", zero).alias("total_commits"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        F.coalesce("authors_count", zero).alias("authors_count"),
        F.coalesce(F.col("last_commit").cast("string"), F.lit("")).alias("last_commit"),
        "last_commit_date",
    )


def repository_info(files: DataFrame, commits: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """`(repo_id, url, local_path, branch, last_commit, total_commits, authors, languages map)`."""
    pairs = F.sort_array(F.collect_list(F.struct("language", "line_count")))
    lines = languages.language_lines(files).groupBy("repo_id").agg(F.map_from_entries(pairs).alias("languages"))
    if repos is None:
        repos = repo_ids(files, commits).selectExpr(
            "repo_id", "cast(null as string) url", "cast(null as string) local_path", "cast(null as string) branch"
        )
    joined = (
        repos.join(history.commit_overview(commits), "repo_id", "left")
        .join(history.recent_authors(commits), "repo_id", "left")
        .join(lines, "repo_id", "left")
    )
    return joined.select(
        "repo_id",
        F.coalesce("url", "local_path").alias("url"),
        "local_path",
        F.coalesce("branch", text.short_hash("last_commit")).alias("branch"),
        F.coalesce(F.col("last_commit").cast("string"), F.lit("")).alias("last_commit"),
        F.coalesce("total_commits", F.lit(0)).alias("total_commits"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"),
    )
