"""Guarded contents of important files and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths, text
from repoquarry.functions.rows import unfold
from repoquarry.operators.importance import level_rank
from repoquarry.operators.skew import first_rows

KEY = ["repo_id", "file_path"]


def join_contents(important: DataFrame, files: DataFrame) -> DataFrame:
    """Important files left-joined to the tree: adds `content`, `size`, `found`.

    The wide file table is first reduced to the wanted keys, a narrow semi join that Spark turns into a broadcast
    whenever the measured size of the keys allows it; contents nobody asked for are then never shuffled.
    """
    wanted = important.select(*KEY)
    named = files.select("repo_id", F.col("path").alias("file_path"), "content", "size")
    return important.join(_found(named.join(wanted, KEY, "left_semi")), KEY, "left")


def _found(files: DataFrame) -> DataFrame:
    return files.withColumn("found", F.lit(True))


def _directories(important: DataFrame, files: DataFrame) -> DataFrame:
    """Keys of important files that are directories of the tree."""
    # Distinct before the join: a directory with a third of all files is one row of each task.
    above = unfold(files, ["repo_id"], paths.ancestor_dirs("path"), "file_path").distinct()
    return above.join(important.select(*KEY), KEY, "left_semi").withColumn("is_dir", F.lit(True))


def read_contents(
    important: DataFrame,
    files: DataFrame,
    max_bytes: int = fixed.MAX_CONTENT_BYTES,
    max_lines: int = fixed.MAX_CONTENT_LINES,
) -> DataFrame:
    """`important` with `content`, `file_size_bytes`, `line_count`, `is_readable`, `error_message`.

    The first failing guard decides: missing, not a file, binary suffix, too large, undecodable. Texts are cut to
    `max_lines` lines in the scan, before anything is shuffled, and counters that need no text do not carry it.
    """
    wanted = important.select(*KEY)
    named = files.select("repo_id", F.col("path").alias("file_path"), "content", "size")
    kept = named.join(wanted, KEY, "left_semi")
    open_file = ~paths.is_binary_ext("file_path") & (F.col("size") <= max_bytes)
    prepared = kept.select(
        *KEY,
        F.lit(True).alias("found"),
        "size",
        F.col("content").isNotNull().alias("has_text"),
        F.when(open_file, text.truncate_lines("content", max_lines)).alias("text"),
        F.when(open_file, text.truncated_line_count("content", max_lines)).alias("lines"),
    )
    joined = important.join(prepared, KEY, "left").join(_directories(important, files), KEY, "left")
    binary, large = paths.is_binary_ext("file_path"), F.col("size") > max_bytes
    not_a_file = F.col("is_dir").isNotNull() | F.col("file_path").isin("", ".")
    error = (
        F.when(F.col("found").isNull() & not_a_file, F.lit("Path is not a file"))
        .when(F.col("found").isNull(), F.lit("File does not exist"))
        .when(binary, F.concat(F.lit("Skipped binary/large file type: "), paths.suffix("file_path")))
        .when(large, F.format_string(f"File too large: %d bytes > {max_bytes} bytes", F.col("size").cast("bigint")))
        .when(~F.col("has_text"), F.lit("Could not decode file content"))
    )
    readable = F.col("error_message").isNull()
    seen_size = F.when(F.col("found").isNull() | binary, F.lit(0)).otherwise(F.col("size")).cast("bigint")
    return joined.withColumn("error_message", error).select(
        *important.columns,
        F.when(readable, F.col("text")).otherwise("").alias("content"),
        seen_size.alias("file_size_bytes"),
        F.when(readable, F.col("lines")).otherwise(F.lit(0)).cast("bigint").alias("line_count"),
        readable.alias("is_readable"),
        "error_message",
    )


def content_stats(contents: DataFrame) -> DataFrame:
    """Counters per repository; lines and bytes over readable files only."""
    readable = F.col("is_readable")

    def level(name: str):
        return F.count_if(F.col("importance_level") == name)

    return contents.groupBy("repo_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(readable).alias("successful_reads"),
        F.count_if(~readable).alias("failed_reads"),
        F.coalesce(F.sum(F.when(readable, F.col("line_count"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(readable, F.col("file_size_bytes"))), F.lit(0)).alias("total_size_bytes"),
        level("CRITICAL").alias("critical_files"),
        level("HIGH").alias("high_files"),
        level("MEDIUM").alias("medium_files"),
    )


def head_per_level(files: DataFrame, medium: int = fixed.MEDIUM_FILES) -> DataFrame:
    """CRITICAL and HIGH files all, the first `medium` MEDIUM files of each repository, no others.

    Only MEDIUM files are ranked (with a group limit); the unlimited levels pass straight through.
    """
    kept = files.filter(F.col("importance_level").isin("CRITICAL", "HIGH"))
    capped = first_rows(
        files.filter(F.col("importance_level") == "MEDIUM"), ["repo_id"], [F.asc("ordinal"), F.asc("file_path")], medium
    ).drop("rank")
    return kept.unionByName(capped)


def first_files(files: DataFrame, n: int = fixed.BASIC_FILES) -> DataFrame:
    """The first n files of each repository in answer order."""
    return first_rows(files, ["repo_id"], [F.asc("ordinal"), F.asc("file_path")], n)


def prompt_sections(contents: DataFrame) -> DataFrame:
    """`(repo_id, level_rank, part, ordinal, file_path, text)`: one row per section, headings as part 0.

    Readable files by level; MEDIUM ones limited in number and length and without reasons. The whole prompt of a
    repository is the sections in (level_rank, part, ordinal, file_path) order; it is never built as one value.
    `contents` is used three times; give a table or a checkpoint, or the files are read as often.
    """
    shown = head_per_level(contents.filter("is_readable")).withColumn("level_rank", level_rank("importance_level"))
    medium = F.col("importance_level") == "MEDIUM"
    body = F.when(medium, F.left("content", F.lit(fixed.MEDIUM_CHARACTERS))).otherwise(F.col("content"))
    cut = F.when(medium & (F.length("content") > fixed.MEDIUM_CHARACTERS), F.lit("... (content truncated)"))
    section = text.lines_text(
        F.concat(F.lit("\n--- FILE: "), F.col("file_path"), F.lit(" ---")),
        F.concat(F.lit("Importance: "), F.col("importance_level")),
        F.concat(F.lit("Type: "), F.col("content_type")),
        F.when(~medium, F.concat(F.lit("Reasons: "), F.array_join("reasons", ", "))),
        F.lit("Content:"),
        body,
        cut,
        F.lit("--- END FILE ---\n"),
    )
    sections = shown.select("repo_id", "level_rank", F.lit(1).alias("part"), "ordinal", "file_path", section.alias("text"))
    title = F.element_at(
        F.array(
            F.lit("=== CRITICAL FILES ==="), F.lit("\n=== HIGH IMPORTANCE FILES ==="), F.lit("\n=== MEDIUM IMPORTANCE FILES ===")
        ),
        F.col("level_rank"),
    )
    levels = contents.filter("is_readable").select("repo_id", level_rank("importance_level").alias("level_rank")).distinct()
    headings = levels.filter("level_rank <= 3").select(
        "repo_id",
        "level_rank",
        F.lit(0).alias("part"),
        F.lit(None).cast("bigint").alias("ordinal"),
        F.lit(None).cast("string").alias("file_path"),
        title.alias("text"),
    )
    return headings.unionByName(sections)
