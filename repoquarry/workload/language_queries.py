"""Languages, tree, and the per-repository lists over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import languages, tree
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs

_TABLE = "select repo_id, language, line_count, file_count, percentage, array_to_string(samples, ', ') as sample_files from o_langs"


def _flat(table: DataFrame) -> DataFrame:
    return table.withColumn("sample_files", F.array_join("sample_files", ", "))


@query("language_lines", "select repo_id, language, line_count from o_lines")
def _(t: Inputs) -> DataFrame:
    return languages.language_lines(t.files)


@query("attach_totals", "select repo_id, language, line_count, percentage from o_share")
def _(t: Inputs) -> DataFrame:
    return languages.with_share(languages.language_lines(t.files))


@query("attach_files", _TABLE)
def _(t: Inputs) -> DataFrame:
    return _flat(languages.languages(t.files))


@query("enriched_languages", _TABLE)
def _(t: Inputs) -> DataFrame:
    """The same table from the per-file facts instead of the contents."""
    return _flat(languages.languages(languages.enrich_files(t.files)))


@query("language_file_counts", "select repo_id, language, count(path) as file_count from o_by_language group by all")
def _(t: Inputs) -> DataFrame:
    return languages.file_counts(t.files)


@query("primary_language", "select repo_id, language as primary_language from o_share where rank = 1")
def _(t: Inputs) -> DataFrame:
    return languages.primary_language(languages.language_lines(t.files))


@query(
    "language_summary",
    "select repo_id, count(*) as language_count, cast(sum(file_count) as bigint) as code_files from o_langs group by repo_id",
)
def _(t: Inputs) -> DataFrame:
    return languages.language_summary(languages.languages(t.files))


@query("top_languages", "select repo_id, language, line_count, rank from o_share where rank <= 5")
def _(t: Inputs) -> DataFrame:
    return languages.top_languages(languages.language_lines(t.files), 5)


@query("sorted_by_lines", "select repo_id, language, line_count, rank from o_share")
def _(t: Inputs) -> DataFrame:
    return languages.sorted_by_lines(languages.language_lines(t.files))


@query("sample_files", "select repo_id, language, array_to_string(list(path order by late, n), ', ') as sample_files from o_samples group by all")
def _(t: Inputs) -> DataFrame:
    return _flat(languages.sample_files(t.files))


@query("priority_and_others", "select repo_id, language, path from o_samples")
def _(t: Inputs) -> DataFrame:
    """The two ranked lists of samples as one set of rows."""
    return languages.sample_files(t.files).select("repo_id", "language", F.explode("sample_files").alias("path"))


@query("directory_index", """select repo_id, dir, (ordinal - 1) // 20 as page, max((n + 19) // 20) as pages, count(*) as file_count, string_agg(name, '|' order by name) as names
          from (select *, row_number() over (partition by repo_id, dir order by name) as ordinal, count(*) over (partition by repo_id, dir) as n from o_tree)
          group by all""")
def _(t: Inputs) -> DataFrame:
    index = tree.directory_index(t.files, page_size=20)
    return index.select("repo_id", "dir", "page", "pages", F.size("files").alias("file_count"), F.array_join("files", "|").alias("names"))


@query("directory_totals", "select repo_id, dir, count(*) as file_count from o_tree group by all")
def _(t: Inputs) -> DataFrame:
    return tree.directory_totals(t.files)


@query(
    "directory_counts",
    """select * from (select repo_id, dir, count(*) as file_count, row_number() over (partition by repo_id order by dir) as rank
       from o_tree group by repo_id, dir) where rank <= 10""",
)
def _(t: Inputs) -> DataFrame:
    return tree.directory_counts(t.files)


@query("total_files", "select repo_id, count(*) as total_files from o_tree group by all")
def _(t: Inputs) -> DataFrame:
    return tree.total_files(t.files)


@query(
    "head_per_directory",
    """select repo_id, dir, name, rank, greatest(n - 10, 0) as more from (
         select repo_id, dir, name, row_number() over (partition by repo_id, dir order by name) as rank,
                count(*) over (partition by repo_id, dir) as n from o_tree) where rank <= 10""",
)
def _(t: Inputs) -> DataFrame:
    return tree.head_per_directory(t.files)
