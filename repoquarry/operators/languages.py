"""Lines, files, shares and samples per language and repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths, text
from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import first_rows

def by_lines() -> list[Column]:
    return [F.desc("line_count"), F.asc("language")]


def enrich_files(files: DataFrame) -> DataFrame:
    """Per-file facts (directory, name, suffix, language, lines, README text).

    Written once as a table, it lets every later job but the content ones run without reading contents again; the
    language, tree and profile operators take it in place of `files`.
    """
    return files.select(
        "repo_id",
        "path",
        paths.parent_dir("path").alias("dir"),
        paths.file_name("path").alias("name"),
        paths.suffix("path").alias("suffix"),
        paths.language_of("path").alias("language"),
        paths.is_ignored("path").alias("is_ignored"),
        text.line_count("content").alias("line_count"),
        F.when(F.col("path").isin(fixed.README_NAMES), text.description_of("content")).alias("description"),
        "size",
        "blob",
    )


def counted_lines(files: DataFrame) -> DataFrame:
    """`(repo_id, path, language, line_count)` of the files that count; takes `files` or the enriched table."""
    kept = files.filter(~paths.is_ignored("path"))
    if "line_count" not in files.columns:
        # The language test runs on the path alone, so only files that count have their text looked at.
        kept = kept.filter(paths.language_of("path").isNotNull() & F.col("content").isNotNull())
        return kept.select(
            "repo_id", "path", paths.language_of("path").alias("language"), text.line_count("content").alias("line_count")
        )
    return kept.filter("language is not null and line_count is not null").select("repo_id", "path", "language", "line_count")


def language_lines(files: DataFrame) -> DataFrame:
    """`(repo_id, language, line_count)`: lines of the non-ignored, readable files of each language."""
    return counted_lines(files).groupBy("repo_id", "language").agg(F.sum("line_count").alias("line_count"))


def with_share(lines: DataFrame) -> DataFrame:
    """Adds the percentage of the repository's lines; 0 where a repository has no lines."""
    # At most one row per known language in a group, so the window is small whatever the repository's size.
    total = F.sum("line_count").over(Window.partitionBy("repo_id"))
    share = F.try_divide(F.col("line_count").cast("double"), total.cast("double")) * 100
    return lines.withColumn("percentage", F.coalesce(share, F.lit(0.0)))


def files_by_language(files: DataFrame) -> DataFrame:
    """`(repo_id, language, path)` by the language's extension list; `.tsx` files appear under two languages."""
    tree = files.filter(~paths.is_ignored("path"))
    return unfold(tree, ["repo_id", "path"], paths.listed_languages("path"), "language")


def file_counts(files: DataFrame) -> DataFrame:
    """`(repo_id, language, file_count)`; counted in each task before the shuffle."""
    return files_by_language(files).groupBy("repo_id", "language").agg(F.count("path").alias("file_count"))


def sample_files(files: DataFrame, each: int = 5) -> DataFrame:
    """`(repo_id, language, sample_files)`: up to 5 priority files, then up to 5 others, no back-fill."""
    ranked = first_rows(
        files_by_language(files).withColumn("is_priority", paths.priority_stem("path")),
        ["repo_id", "language", "is_priority"],
        [F.asc("path")],
        each,
    )
    picked = F.sort_array(F.collect_list(F.struct((~F.col("is_priority")).alias("late"), "rank", "path")))
    return (
        ranked.groupBy("repo_id", "language")
        .agg(picked.alias("picked"))
        .select("repo_id", "language", F.col("picked.path").alias("sample_files"))
    )


def attach_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """`languages`: lines, file count, share and samples. Languages without an extension list have 0 files.

    Lines and files follow two different extension tables on purpose (`.tsx` lines count as TSX, `.tsx` files as
    TypeScript).
    """
    counted = with_share(lines).join(file_counts(files), ["repo_id", "language"], "left")
    return counted.join(sample_files(files), ["repo_id", "language"], "left").select(
        "repo_id",
        "language",
        "line_count",
        F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count"),
        "percentage",
        F.coalesce("sample_files", F.array().cast("array<string>")).alias("sample_files"),
    )


def languages(files: DataFrame) -> DataFrame:
    """The whole language table of all repositories."""
    return attach_files(language_lines(files), files)


def top_languages(table: DataFrame, n: int = 5) -> DataFrame:
    """The n languages with most lines per repository, ranked."""
    return first_rows(table, ["repo_id"], by_lines(), n)


def sorted_by_lines(table: DataFrame) -> DataFrame:
    """All languages with their rank by lines."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*by_lines())))


def sorted_struct(*fields: str) -> Column:
    """Aggregate: languages of a repository as an array ordered by lines, ties by name."""
    packed = F.struct((-F.col("line_count")).alias("_neg"), "language", *[F.col(f) for f in fields if f != "language"])
    return F.transform(F.sort_array(F.collect_list(packed)), lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def primary_language(table: DataFrame) -> DataFrame:
    """`(repo_id, primary_language)`: most lines, ties to the first name. Repositories without any are not in it."""
    best = F.min_by("language", F.struct(-F.col("line_count"), F.col("language")))
    return table.groupBy("repo_id").agg(best.alias("primary_language"))


def language_summary(table: DataFrame) -> DataFrame:
    """`(repo_id, language_count, code_files)`."""
    return table.groupBy("repo_id").agg(
        F.count("language").alias("language_count"), F.sum("file_count").alias("code_files")
    )


def languages_list(table: DataFrame, with_share: bool = True) -> DataFrame:
    """`(repo_id, languages_list)`: "Python (62.5%), ..." or names only, by lines."""
    entries = sorted_struct("language", "percentage")

    def show(e: Column) -> Column:
        return F.concat(e["language"], F.lit(" ("), text.percent(e["percentage"]), F.lit("%)")) if with_share else e["language"]

    packed = table.groupBy("repo_id").agg(entries.alias("entries"))
    return packed.select("repo_id", F.array_join(F.transform("entries", show), ", ").alias("languages_list"))
