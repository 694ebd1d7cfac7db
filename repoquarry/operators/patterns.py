"""The pattern catalogue: looking it up and matching paths against it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths
from repoquarry.functions.rows import unfold

# category -> entries (key, pattern); the key names a language or framework, "" elsewhere.
CATALOGUE: dict[str, list[tuple[str, str]]] = {
    "entry_points": [(k, p) for k, ps in fixed.ENTRY_POINTS.items() for p in ps],
    "config_files": [("", p) for p in fixed.CONFIG_PATTERNS],
    "test_files": [("", p) for p in fixed.TEST_PATTERNS],
    "build_files": [("", p) for p in fixed.BUILD_PATTERNS],
    "framework_files": [(k, p) for k, ps in fixed.FRAMEWORK_FILES.items() for p in ps],
    "doc_files": [("", p) for p in fixed.DOC_PATTERNS],
    "asset_files": [("", p) for p in fixed.ASSET_PATTERNS],
    "utility_files": [("", p) for p in fixed.UTILITY_PATTERNS],
}
# Categories handed out for a language; the last two of the catalogue are not among them.
LANGUAGE_CATEGORIES = list(CATALOGUE)[:6]


def find_regex(pattern: str) -> str:
    """The pattern as a regex searched for in a relative path.

    The path has a slash before it, so that folders at the root are found like others. Plain names must be the whole file
    name, names ending in a slash a directory. A leading ".*" means nothing to a search and only makes it slower.
    """
    if re.search(r"[\\^$*+?()|\[]", pattern):
        return re.sub(r"^\.\*", "", pattern)
    if pattern.endswith("/"):
        return rf"/{re.escape(pattern)}"
    return rf"/{re.escape(pattern)}$"


def category_regex(category: str) -> str:
    return "|".join(f"(?:{find_regex(p)})" for _, p in CATALOGUE[category])


def catalogue_table(spark: SparkSession) -> DataFrame:
    """`(category, key, ordinal, pattern)`; fixed size."""
    rows = [(c, k, i, p) for c, entries in CATALOGUE.items() for i, (k, p) in enumerate(entries)]
    literals = ", ".join(
        "({!s}, {!s}, {}, {!s})".format(_sql(c), _sql(k), i, _sql(p)) for c, k, i, p in rows
    )
    return spark.sql(f"select * from values {literals} as catalogue(category, key, ordinal, pattern)")


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entry_point_patterns(spark: SparkSession, language: str) -> DataFrame:
    """Entry point patterns of a language, any case; none for an unknown one."""
    return _lookup(spark, "entry_points", language)


def framework_patterns(spark: SparkSession, framework: str) -> DataFrame:
    return _lookup(spark, "framework_files", framework)


def config_patterns(spark: SparkSession) -> DataFrame:
    return _lookup(spark, "config_files", "")


def test_patterns(spark: SparkSession) -> DataFrame:
    return _lookup(spark, "test_files", "")


def _lookup(spark: SparkSession, category: str, key: str) -> DataFrame:
    table = catalogue_table(spark)
    return table.filter((F.col("category") == category) & (F.col("key") == key.lower())).select("ordinal", "pattern")


def patterns_for_language(languages: DataFrame) -> DataFrame:
    """`(language, category, key, ordinal, pattern)`: all patterns that apply to each language of the input.

    Entry points are those of the language; every other category is the same for all.
    """
    spark = languages.sparkSession
    wanted = languages.select("language", F.explode(F.array(F.lower("language"), F.lit(None))).alias("lookup"))
    table = catalogue_table(spark).filter(F.col("category").isin(LANGUAGE_CATEGORIES))
    applies_to = F.when(F.col("category") == "entry_points", F.col("key"))
    # A null lookup meets the categories that hold for every language.
    return wanted.join(
        F.broadcast(table.withColumn("applies_to", applies_to)), F.col("lookup").eqNullSafe(F.col("applies_to"))
    ).select("language", "category", "key", "ordinal", "pattern")


def language_extensions(spark: SparkSession) -> DataFrame:
    """`(language, ext)`; `.tsx` belongs to two languages."""
    rows = ", ".join(f"('{k}', '{e}')" for k, exts in fixed.EXTENSIONS_OF_LANGUAGE.items() for e in exts)
    return spark.sql(f"select * from values {rows} as listed(language, ext)")


FLAGS = {
    "is_entry_point": "entry_points",
    "is_config": "config_files",
    "is_test": "test_files",
    "is_doc": "doc_files",
    "is_build": "build_files",
    "is_asset": "asset_files",
    "is_utility": "utility_files",
    "is_framework": "framework_files",
}


def flag(path: Column | str, category: str) -> Column:
    return F.concat(F.lit("/"), paths.col(path)).rlike(category_regex(category))


def match_patterns(files: DataFrame) -> DataFrame:
    """`(repo_id, path, is_...)`: one flag per category, one alternation regex each."""
    return files.select("repo_id", "path", *[flag("path", c).alias(n) for n, c in FLAGS.items()])


def explain_pattern(files: DataFrame) -> DataFrame:
    """`(repo_id, path, category, key, pattern)`: every pattern each path matches.

    Map-side only: each regex is a literal compiled once, and the single patterns of a category are tried only on paths
    its alternation matches.
    """

    def matched(category: str) -> str:
        # One SQL text: over a hundred Column objects would cost seconds of driver time before anything runs.
        hits = ", ".join(
            f"case when concat('/', path) rlike r'{find_regex(p)}' then named_struct('category', '{category}', 'key', '{k}', 'pattern', r'{p}') end"
            for k, p in CATALOGUE[category]
        )
        return f"case when concat('/', path) rlike r'{category_regex(category)}' then array_compact(array({hits})) else array() end"

    hits = F.expr(f"concat({', '.join(map(matched, CATALOGUE))})")
    return unfold(files, ["repo_id", "path"], hits, "hit").select("repo_id", "path", "hit.*")


def framework_keys(path: Column | str) -> Column:
    """File name and the directory parts (with a slash) that can name a framework."""
    dirs = [p for ps in fixed.FRAMEWORK_FILES.values() for p in ps if p.endswith("/")]
    p = paths.col(path)
    parts = F.transform(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), lambda x: F.concat(x, F.lit("/")))
    return F.concat(F.array(paths.file_name(p)), F.array_distinct(F.filter(parts, lambda x: x.isin(dirs))))


def detect_frameworks(files: DataFrame, minimum: int = 1) -> DataFrame:
    """`(repo_id, framework, patterns_found, hits)`: frameworks with at least `minimum` of their patterns present."""
    rows = ", ".join(f"('{k}', '{p}')" for k, ps in fixed.FRAMEWORK_FILES.items() for p in ps)
    known = files.sparkSession.sql(f"select * from values {rows} as known(framework, pattern)")
    keys = unfold(files, ["repo_id"], framework_keys("path"), "pattern")
    # Counted per name before the join, so the join sees each name of a repository once.
    names = keys.groupBy("repo_id", "pattern").agg(F.count("*").alias("hits"))
    found = names.join(F.broadcast(known), "pattern").groupBy("repo_id", "framework")
    return found.agg(F.count("*").alias("patterns_found"), F.sum("hits").alias("hits")).filter(
        F.col("patterns_found") >= minimum
    )
