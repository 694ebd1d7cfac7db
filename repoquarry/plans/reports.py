"""Reports. Tables first; text is a thin last projection.

Reports whose length is bounded (top languages, ten directories, fifteen files) are one text per repository. Reports that
grow with a repository (every file, every directory) stay tables of lines with explicit order columns, so no task ever
holds the report of a whole large repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, text
from repoquarry.operators import contents as contents_ops
from repoquarry.operators import history, importance, tree
from repoquarry.operators.importance import level_rank
from repoquarry.plans.profile import LANGUAGES
from repoquarry.session import cut_lineage


def _languages() -> Column:
    return F.coalesce(F.col("languages"), F.array().cast(LANGUAGES))


def language_summary_column() -> Column:
    """Language summary of a profile row.

    Sample files are shown while the text has at most eight lines after the language's own line: for the first two
    languages, or for the third when the first two have none.
    """
    langs = _languages()
    top = F.slice(langs, 1, 10)
    early = F.exists(F.slice(langs, 1, 2), lambda e: F.size(e["sample_files"]) > 0)

    def entry(e: Column, i: Column) -> Column:
        head = text.fill(fixed.SUMMARY_LANGUAGE, language=e["language"], share=text.percent(e["percentage"]), lines=text.grouped(e["line_count"]), files=e["file_count"])
        shown = (F.size(e["sample_files"]) > 0) & ((i < 2) | ((i == 2) & ~early))
        samples = text.fill(fixed.SUMMARY_SAMPLES, samples=F.array_join(F.slice(e["sample_files"], 1, 3), ", "))
        return F.when(shown, F.concat(head, samples)).otherwise(head)

    code_files = F.aggregate(langs, F.lit(0).cast("bigint"), lambda total, e: total + e["file_count"])
    head = text.fill_lines(fixed.SUMMARY_HEAD, primary_language="primary_language", language_count=F.size(langs), code_files=code_files)
    lines = F.concat(head, F.transform(top, entry))
    return F.when(F.size(langs) == 0, F.lit(fixed.NO_LANGUAGES)).otherwise(F.array_join(lines, "\n"))


def language_summary_text(profile: DataFrame) -> DataFrame:
    return profile.select("repo_id", language_summary_column().alias("summary"))


def search_context(profile: DataFrame) -> DataFrame:
    """`(repo_id, context)`: address, primary language, language summary."""
    context = text.fill(fixed.SEARCH_CONTEXT, url=F.coalesce("repo_url", F.lit("None")), primary_language="primary_language", summary=language_summary_column())
    return profile.select("repo_id", context.alias("context"))


def content_summary(contents: DataFrame) -> DataFrame:
    """Line table `(repo_id, section, ordinal, file_path, line)`: counters, then one line per file."""
    stats = contents_ops.content_stats(contents)
    head = text.fill_lines(
        fixed.CONTENT_SUMMARY_HEAD,
        **{c: c for c in ("total_files", "successful_reads", "failed_reads", "critical_files", "high_files", "medium_files")},
        total_lines=text.grouped("total_lines"),
        total_size=text.grouped("total_size_bytes"),
    )
    line = F.when(
        F.col("is_readable"),
        text.fill(fixed.READABLE_FILE, path="file_path", level="importance_level", lines="line_count"),
    ).otherwise(text.fill(fixed.UNREADABLE_FILE, path="file_path", error="error_message"))
    return _head_lines(stats, head).unionByName(_file_lines(contents, line))


def _head_lines(stats: DataFrame, lines: Column, section: int = 0) -> DataFrame:
    rows = stats.select("repo_id", F.posexplode(lines).alias("ordinal", "line"))
    return rows.select(
        "repo_id", F.lit(section).alias("section"), F.col("ordinal").cast("bigint").alias("ordinal"),
        F.lit(None).cast("string").alias("file_path"), "line",
    )


def _file_lines(files: DataFrame, line: Column, section: int = 1) -> DataFrame:
    return files.select("repo_id", F.lit(section).alias("section"), "ordinal", "file_path", line.alias("line"))


def _listed_directories(files: DataFrame, n: int = 10) -> DataFrame:
    head = tree.directory_counts(files, n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "dir", "file_count")))
    return head.groupBy("repo_id").agg(ordered.alias("directories"))


def _listed_files(contents: DataFrame, n: int = fixed.BASIC_FILES) -> DataFrame:
    """The readable ones among the first n files of each repository (the cut comes before the test)."""
    head = contents_ops.first_files(contents.drop("content"), n).filter("is_readable")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "file_path", "importance_level", "content_type")))
    return head.groupBy("repo_id").agg(ordered.alias("listed"))


def with_overview_parts(profile: DataFrame, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Profile rows with what an overview lists: ten directories and, given contents, counters and fifteen files."""
    joined = profile.join(_listed_directories(files), "repo_id", "left")
    if contents is None:
        return joined
    stats = contents_ops.content_stats(contents).withColumnRenamed("total_files", "content_files")
    return joined.join(stats, "repo_id", "left").join(_listed_files(contents), "repo_id", "left")


def overview_column(with_contents: bool) -> Column:
    """Markdown overview of a row made by `with_overview_parts`."""
    langs = _languages()

    def language_line(e: Column) -> Column:
        return text.fill(fixed.OVERVIEW_LANGUAGE, language=e["language"], lines=text.grouped(e["line_count"]), share=text.percent(e["percentage"]))

    def directory_line(d: Column) -> Column:
        name = F.when(d["dir"] == ".", "Root directory").otherwise(d["dir"])
        return text.fill(fixed.OVERVIEW_DIRECTORY, name=name, files=d["file_count"])

    head = text.fill_lines(
        fixed.OVERVIEW_HEAD,
        url=F.coalesce("repo_url", F.lit("Local repository")),
        **{c: c for c in ("primary_language", "total_files", "total_commits", "authors_count")},
    )
    used = F.when(F.size(langs) > 0, F.transform(langs, language_line)).otherwise(
        F.array(F.lit("- No language information available"))
    )
    structure = text.fill_lines(fixed.OVERVIEW_STRUCTURE)
    nothing = F.array().cast("array<string>")
    directories = F.coalesce(F.transform("directories", directory_line), nothing)
    parts = [head, used, structure, directories]
    if with_contents:
        counters = ("successful_reads", "content_files", "critical_files", "high_files", "medium_files")
        numbers = {c: F.coalesce(c, F.lit(0)) for c in counters}
        total_lines = text.grouped(F.coalesce("total_lines", F.lit(0)))
        parts.append(text.fill_lines(fixed.OVERVIEW_CONTENTS, **numbers, total_lines=total_lines))
        parts.append(
            F.coalesce(
                F.transform("listed", lambda f: text.fill(fixed.OVERVIEW_FILE, path=f["file_path"], level=f["importance_level"], type=f["content_type"])),
                nothing,
            )
        )
    parts.append(F.array(*map(F.lit, fixed.OVERVIEW_NOTES)))
    return F.array_join(F.concat(*parts), "\n")


def _overview_columns(with_contents: bool) -> list[Column]:
    analyzed = F.coalesce("successful_reads", F.lit(0)) if with_contents else F.lit(0).cast("bigint")
    return [
        overview_column(with_contents).alias("overview"),
        analyzed.alias("total_files_analyzed"),
        F.lit("basic").alias("analysis_status"),
        F.lit("Basic Repository Analysis").alias("analysis_method"),
    ]


def basic_overview(profile: DataFrame, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """`(repo_id, repo_url, primary_language, overview, total_files_analyzed, analysis_status, analysis_method)`."""
    whole = with_overview_parts(profile, files, contents)
    return whole.select("repo_id", "repo_url", "primary_language", *_overview_columns(contents is not None))


def fallback_overview(profile: DataFrame, contents: DataFrame) -> DataFrame:
    """Line table of the shorter overview with every readable file: `(repo_id, section, ordinal, file_path, line)`."""
    stats = contents_ops.content_stats(contents).withColumnRenamed("total_files", "content_files")
    joined = profile.join(stats, "repo_id", "left").fillna(
        0, ["successful_reads", "content_files", "critical_files", "high_files", "medium_files"]
    )
    names = F.array_join(F.transform(_languages(), lambda e: e["language"]), ", ")
    head = text.fill_lines(
        fixed.FALLBACK_HEAD,
        url=F.coalesce("repo_url", F.lit("Local repository")),
        languages=F.when(F.size(_languages()) > 0, names).otherwise("Unknown"),
        **{c: c for c in ("primary_language", "successful_reads", "content_files", "critical_files", "high_files", "medium_files")},
    )
    line = text.fill(fixed.FALLBACK_FILE, path="file_path", level="importance_level")
    return (
        _head_lines(joined, head, 0)
        .unionByName(_file_lines(contents.filter("is_readable"), line, 1))
        .unionByName(_head_lines(profile.select("repo_id"), F.array(F.lit(""), F.lit(fixed.FALLBACK_NOTE)), 2))
    )


def directory_text(files: DataFrame, n: int = 10) -> DataFrame:
    """`(repo_id, dir, text)`: one block per directory with n names and how many more; blocks end with a blank line."""
    head = tree.head_per_directory(files, n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "name")))
    blocks = head.groupBy("repo_id", "dir").agg(ordered.alias("head"), F.max("more").alias("more"))
    title = F.when(F.col("dir") == ".", F.lit(fixed.ROOT_TITLE)).otherwise(text.fill(fixed.DIRECTORY_TITLE, dir="dir"))
    names = F.transform("head", lambda e: text.fill(fixed.DIRECTORY_FILE, name=e["name"]))
    more = F.when(F.col("more") > 0, F.array(text.fill(fixed.DIRECTORY_MORE, more="more"))).otherwise(F.array().cast("array<string>"))
    return blocks.select(
        "repo_id", "dir", F.array_join(F.concat(F.array(title), names, more, F.array(F.lit(""))), "\n").alias("text")
    )


def repo_card(profile: DataFrame) -> DataFrame:
    """`(repo_id, card)`: address, branch, commits, newest commit, contributors, ten languages."""
    count = F.size("authors")
    people = text.fill(fixed.CARD_PEOPLE, count=count, authors=F.array_join(F.slice("authors", 1, 5), ", "))
    entries = F.transform(F.slice(_languages(), 1, 10), lambda e: text.fill(fixed.CARD_LANGUAGE, language=e["language"], lines=e["line_count"]))
    empty = F.lit("")
    card = text.lines_text(
        text.fill(
            fixed.CARD_HEAD,
            url=F.coalesce("repo_url", empty),
            path=F.coalesce("local_path", empty),
            branch=F.coalesce("branch", empty),
            commits="total_commits",
            last=text.short_hash("last_commit"),
        ),
        F.when(count > 0, people),
        F.when(count > 5, text.fill(fixed.CARD_MORE_PEOPLE, more=count - 5)),
        F.when(F.size(_languages()) > 0, text.fill(fixed.CARD_LANGUAGES, languages=F.array_join(entries, "\n"))),
    )
    return profile.select("repo_id", card.alias("card"))


def commit_digest(commits: DataFrame, changes: DataFrame, n: int = fixed.DIGEST_COMMITS) -> DataFrame:
    """`(repo_id, rank, commit_id, file_count, total_additions, total_deletions, text)` of the n newest commits.

    Changes are cut to those commits before they are counted.
    """
    recent = history.recent_commits(commits, n)
    rolled = history.commit_rollup(recent, history.changes_of(changes, recent))
    files = F.col("file_count")
    many = F.when(files == 1, fixed.DIGEST_FILE).otherwise(fixed.DIGEST_FILES)
    entry = text.lines_text(
        text.fill(fixed.DIGEST_HEAD, rank="rank", hash=text.short_hash("commit_id"), author="author"),
        text.fill(fixed.DIGEST_TIME, time=F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        text.fill(fixed.DIGEST_MESSAGE, headline=text.message_headline(text.strip_text("message"))),
        F.when(files > 0, F.replace(many, F.lit("{files}"), files.cast("string"))),
        F.when(
            (files > 0) & ((F.col("total_additions") > 0) | (F.col("total_deletions") > 0)),
            text.fill(fixed.DIGEST_LINES, added="total_additions", deleted="total_deletions"),
        ),
    )
    return rolled.select(
        "repo_id", "rank", "commit_id", "file_count", "total_additions", "total_deletions", entry.alias("text")
    )


def _present(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def with_importance(profile: DataFrame, important: DataFrame) -> DataFrame:
    """Profile rows with counts, confidence and the first critical files of the important files."""
    return profile.join(importance.importance_stats(important), "repo_id", "left").join(
        importance.first_critical(important), "repo_id", "left"
    )


def insights_column() -> Column:
    """Sentences on the primary language, critical and high files and the mean confidence."""
    first = F.try_element_at(_languages(), F.lit(1))
    critical, high = F.coalesce("critical", F.lit(0)), F.coalesce("high", F.lit(0))
    return _present(
        F.when(first.isNotNull(), text.fill(fixed.INSIGHT_LANGUAGE, language=first["language"], share=text.percent(first["percentage"]))),
        F.when(critical > 0, text.fill(fixed.INSIGHT_CRITICAL, critical=critical)),
        F.when(high > 0, text.fill(fixed.INSIGHT_HIGH, high=high)),
        text.fill(fixed.INSIGHT_CONFIDENCE, share=text.percent(F.coalesce("avg_confidence", F.lit(0.0)) * 100)),
    )


def recommendations_column() -> Column:
    """Sentences on critical files, the primary language and configuration files."""
    by_language = F.lit(None).cast("string")
    for names, sentence in reversed(fixed.LANGUAGE_RECOMMENDATIONS):
        by_language = F.when(F.lower("primary_language").isin(names), F.lit(sentence)).otherwise(by_language)
    return _present(
        F.when(
            F.col("critical_paths").isNotNull(),
            text.fill(fixed.CRITICAL_RECOMMENDATION, paths=F.array_join("critical_paths", ", ")),
        ),
        by_language,
        F.when(F.col("has_config"), F.lit(fixed.CONFIG_RECOMMENDATION)),
    )


def insights(profile: DataFrame, important: DataFrame) -> DataFrame:
    """`(repo_id, insights)`."""
    return with_importance(profile, important).select("repo_id", insights_column().alias("insights"))


def recommendations(profile: DataFrame, important: DataFrame) -> DataFrame:
    """`(repo_id, recommendations)`."""
    return with_importance(profile, important).select("repo_id", recommendations_column().alias("recommendations"))


def _result_columns() -> list[Column]:
    return [
        F.coalesce("important_count", F.lit(0)).alias("important_count"),
        insights_column().alias("insights"),
        recommendations_column().alias("recommendations"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
    ]


def analysis_result(profile: DataFrame, important: DataFrame) -> DataFrame:
    """`(repo_id, important_count, insights, recommendations, confidence_score)` of parsed important files."""
    return with_importance(profile, important).select("repo_id", *_result_columns())


def analyze_basic(profile: DataFrame, files: DataFrame, n: int = fixed.BASIC_FILES) -> DataFrame:
    """Result of the name-based analysis: `(repo_id, important_count, insights, recommendations, confidence_score)`.

    The files themselves are `importance.classify_basic(files, n)`.
    """
    counted = importance.classify_basic(files, n).groupBy("repo_id").agg(F.count("*").alias("important_count"))
    joined = profile.join(counted, "repo_id", "left").withColumn("important_count", F.coalesce("important_count", F.lit(0)))
    done, better = fixed.BASIC_INSIGHTS
    return joined.select(
        "repo_id",
        "important_count",
        F.array(
            F.lit(done),
            text.fill(fixed.BASIC_IMPORTANT, count="important_count"),
            text.fill(fixed.BASIC_LANGUAGE, language="primary_language"),
            F.lit(better),
        ).alias("insights"),
        F.array(*map(F.lit, fixed.BASIC_RECOMMENDATIONS)).alias("recommendations"),
        F.lit(0.4).alias("confidence_score"),
    )


def analyze_overview(profile: DataFrame, important: DataFrame, files: DataFrame) -> DataFrame:
    """Contents read, counted and laid out as the basic overview."""
    return basic_overview(profile, files, _content_facts(important, files))


def _content_facts(important: DataFrame, files: DataFrame) -> DataFrame:
    """What overviews need of the contents: no texts. Two parts use it, so it is kept; contents are read once."""
    return cut_lineage(contents_ops.read_contents(important, files).drop("content"))


def project_analysis(profile: DataFrame, important: DataFrame, files: DataFrame) -> DataFrame:
    """Profile, analysis result and overview of each repository in one row; the profile is computed once."""
    counted = with_importance(profile, important)
    whole = with_overview_parts(counted, files, _content_facts(important, files))
    return whole.select(*profile.columns, *_result_columns(), *_overview_columns(True))


def important_files_report(important: DataFrame) -> DataFrame:
    """Line table `(repo_id, level_rank, ordinal, file_path, line_no, line)` of the important files by level."""
    confidence = importance.overall_confidence(important)
    head = confidence.select(
        "repo_id",
        F.posexplode(
            F.array(
                F.lit("# Important Files Analysis"),
                F.lit(""),
                text.fill(fixed.REPORT_CONFIDENCE, share=text.percent(F.col("confidence_score") * 100)),
                F.lit(""),
            )
        ).alias("line_no", "line"),
    ).select("repo_id", F.lit(0).alias("level_rank"), *_no_file(), "line_no", "line")
    shown = important.withColumn("level_rank", level_rank("importance_level")).filter("level_rank <= 3")
    titles = (
        shown.select("repo_id", "level_rank", "importance_level")
        .distinct()
        .select("repo_id", "level_rank", *_no_file(), F.posexplode(F.array(text.fill(fixed.REPORT_LEVEL, level="importance_level"), F.lit(""))).alias("line_no", "line"))
    )
    body = shown.select(
        "repo_id",
        "level_rank",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "file_path",
        F.posexplode(
            F.array(
                text.fill(fixed.REPORT_FILE, path="file_path"),
                text.fill(fixed.REPORT_TYPE, type="content_type"),
                text.fill(fixed.REPORT_FILE_CONFIDENCE, share=text.percent(F.col("confidence_score") * 100)),
                text.fill(fixed.REPORT_REASONS, reasons=F.array_join("reasons", ", ")),
                F.lit(""),
            )
        ).alias("line_no", "line"),
    )
    return head.unionByName(titles).unionByName(body)


def _no_file() -> list[Column]:
    # Nulls sort first, so headings precede the files of their level.
    return [F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("string").alias("file_path")]
