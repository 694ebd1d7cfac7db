"""Documentation, tests, debt markers, secrets, trends and totals across repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions import paths
from repoquarry.functions.rows import unfold
from repoquarry.operators.patterns import flag
from repoquarry.sources.tree import file_tree

_SECRET_NAME = r"(password|passwd|secret|api[_-]?key|token)(_[a-z0-9_]{1,40})?"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Kinds of sensitive text, masked in this order.
SENSITIVE = {
    "private_key": r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    "access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "token": r"\b(github_pat|ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp)[-_][0-9A-Za-z_-]{20,}",
    "authorization": r"(?i)\b(bearer|basic)[ \t]+[0-9A-Za-z._~+/-]{16,}=*",
    "url_password": r"\b[A-Za-z][0-9A-Za-z+.-]{1,30}://[^\s/:@]{0,200}:[^\s/@]{1,200}@",
    # A quoted name or value goes with both its quotes, so what is left stays balanced.
    "assigned_secret": rf"(?i)(\x22{_SECRET_NAME}\x22|\x27{_SECRET_NAME}\x27|{_SECRET_NAME})[ \t]*[:=][ \t]*"
    r"(\x22[^\x22\n]{6,}\x22|\x27[^\x27\n]{6,}\x27|[\x22\x27]?[^\s,;\x22\x27}]{6,})",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    # Not a part of a longer row of numbers, as in a version.
    "ipv4": rf"(?<![0-9])(?<![0-9]\.){_OCTET}(\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "phone": r"\+?[0-9]{1,3}[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -]?[0-9]{4}\b",
}
# Every passage of a kind holds one of these literals, or meets the plainer regex; other texts are spared the regex of the kind.
_LITERALS = {
    "private_key": ["-----BEGIN"],
    "access_key": ["AKIA", "ASIA"],
    "token": ["github_pat", "ghp", "gho", "ghu", "ghs", "ghr", "glpat", "xoxb", "xoxp"],
    "url_password": ["://"],
    "assigned_secret": [":", "="],
    "email": ["@"],
}
_PLAINER = {"authorization": r"(?i)(bearer|basic)[ \t]", "ipv4": r"[0-9]\.[0-9]", "phone": "[0-9]{3}[ -]?[0-9]{4}"}
MARKERS = ["TODO", "FIXME", "HACK"]


def _may_hold(value: Column, kind: str) -> Column:
    if kind in _PLAINER:
        return value.rlike(_PLAINER[kind])
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(word)) for word in _LITERALS[kind]])


def _masking_steps(files: DataFrame) -> DataFrame:
    """Columns `_left0`, `_left1`, ...: the content after masking the first 0, 1, ... kinds.

    One projection per kind: a column used several times is kept by the optimizer, a nested expression would be repeated.
    """
    step = files.withColumn("_left0", F.col("content"))
    for i, (kind, regex) in enumerate(SENSITIVE.items()):
        before = F.col(f"_left{i}")
        after = F.when(_may_hold(before, kind), F.regexp_replace(before, regex, f"[{kind.upper()}]")).otherwise(before)
        step = step.withColumn(f"_left{i + 1}", after)
    return step


def mask_sensitive(files: DataFrame) -> DataFrame:
    """`(repo_id, path, content)` with every sensitive passage replaced by its kind in brackets."""
    return _masking_steps(files).select("repo_id", "path", F.col(f"_left{len(SENSITIVE)}").alias("content"))


def sensitive_findings(files: DataFrame) -> DataFrame:
    """`(repo_id, path, kind, findings)`: passages per kind, each counted in the text left by the kinds before it."""

    def found(i: int, kind: str, regex: str) -> Column:
        text = F.col(f"_left{i}")
        count = F.when(_may_hold(text, kind), F.regexp_count(text, F.lit(regex)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.struct(F.lit(kind).alias("kind"), count.alias("findings"))

    counts = [found(i, kind, regex) for i, (kind, regex) in enumerate(SENSITIVE.items())]
    listed = F.filter(F.array(*counts), lambda c: c["findings"] > 0)
    rows = unfold(_masking_steps(files), ["repo_id", "path"], listed, "found")
    return rows.select("repo_id", "path", "found.*")


def doc_coverage(files: DataFrame) -> DataFrame:
    """Share of directories with a documentation file, and of code files lying in such directories."""
    code = paths.language_of("path").isNotNull() & ~flag("path", "doc_files")
    marked = file_tree(files).select("repo_id", "dir", flag("path", "doc_files").alias("is_doc"), code.alias("is_code"))
    dirs = marked.groupBy("repo_id", "dir").agg(F.bool_or("is_doc").alias("documented"), F.count_if("is_code").alias("code_files"))
    documented_code = F.sum(F.when(F.col("documented"), F.col("code_files")).otherwise(0))
    return dirs.groupBy("repo_id").agg(
        F.count("*").alias("directories"),
        F.count_if("documented").alias("documented_directories"),
        F.avg(F.col("documented").cast("double")).alias("directory_coverage"),
        F.coalesce(F.try_divide(documented_code.cast("double"), F.sum("code_files")), F.lit(0.0)).alias("file_coverage"),
    )


def test_share(files: DataFrame) -> DataFrame:
    """`(repo_id, test_files, source_files, tests_per_source)` over files of a known language."""
    code = file_tree(files).filter(paths.language_of("path").isNotNull())
    is_test = flag("path", "test_files")
    tests, sources = F.count_if(is_test), F.count_if(~is_test)
    return code.groupBy("repo_id").agg(
        tests.alias("test_files"),
        sources.alias("source_files"),
        F.try_divide(tests.cast("double"), sources).alias("tests_per_source"),
    )


def _marker_count(marker: str) -> Column:
    # The cheap search spares most texts the regex.
    found = F.regexp_count("content", F.lit(rf"\b{marker}\b")).cast("bigint")
    return F.when(F.contains("content", F.lit(marker)), found).otherwise(F.lit(0).cast("bigint"))


def debt_markers(files: DataFrame) -> DataFrame:
    """`(repo_id, path, language, todo, fixme, hack)` of the files holding any."""
    counted = files.filter(~paths.is_ignored("path")).select(
        "repo_id",
        "path",
        F.coalesce(paths.language_of("path"), F.lit("Other")).alias("language"),
        *[_marker_count(m).alias(m.lower()) for m in MARKERS],
    )
    return counted.filter("todo + fixme + hack > 0")


def debt_rollup(files: DataFrame) -> DataFrame:
    """Markers per (repository, language), per repository and overall; totals have null keys and a level of 1 and 3."""
    names = [m.lower() for m in MARKERS]
    return debt_markers(files).rollup("repo_id", "language").agg(
        F.count("*").alias("files"), *[F.sum(n).alias(n) for n in names], F.grouping_id().cast("bigint").alias("level")
    )


_STEPS = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def dense_periods(rows: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """Every period between the first and the last of each key, also those `rows(keys, period)` has no row for."""
    ends = rows.groupBy(*keys).agg(F.min("period").alias("_first"), F.max("period").alias("_last"))
    spine = F.expr(f"sequence(_first, _last, interval {_STEPS[period]})")
    return unfold(ends, keys, spine, "period")


def health_trend(changes: DataFrame, period: str = "month", window: int = 4) -> DataFrame:
    """`(repo_id, period, changes, churn, churn_avg, churn_delta)`: churn, its moving average and change to the period before.

    There is a row for every period from a repository's first change to its last: a period without changes has zeros and counts
    in the average and as the period before. Changes without a time are in no period. Windows run over one row per repository and period.
    """
    counted = changes.filter("ts is not null").groupBy("repo_id", F.date_trunc(period, "ts").alias("period")).agg(
        F.count("*").alias("changes"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn")
    )
    zero = F.lit(0).cast("bigint")
    periods = dense_periods(counted, period, ["repo_id"]).join(counted, ["repo_id", "period"], "left").select(
        "repo_id", "period", F.coalesce("changes", zero).alias("changes"), F.coalesce("churn", zero).alias("churn")
    )
    order = Window.partitionBy("repo_id").orderBy("period")
    return periods.withColumn("churn_avg", F.avg("churn").over(order.rowsBetween(1 - window, 0))).withColumn(
        "churn_delta", F.col("churn") - F.lag("churn").over(order)
    )


def cross_repo_rollup(languages: DataFrame) -> DataFrame:
    """Lines and files per (repository, language), per repository, per language and overall."""
    return languages.cube("repo_id", "language").agg(
        F.sum("line_count").alias("line_count"),
        F.sum("file_count").alias("file_count"),
        F.grouping_id().cast("bigint").alias("level"),
    )
