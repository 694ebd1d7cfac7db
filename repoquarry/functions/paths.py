"""Column functions on paths and repository addresses (all JVM-side, no Python rows)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(words: list[str]) -> str:
    """Regex finding any of the literal words."""
    return "|".join(re.escape(word) for word in words)


def _ignored_regex() -> str:
    # Names starting with a dot are out whatever follows, so the listed dot names add nothing.
    named = [part for part in fixed.IGNORED_PARTS if not part.startswith(".")]
    return rf"(^|/)([.]|({any_of(named)})(/|$))"


IGNORED_REGEX = _ignored_regex()


def is_ignored(path: Column | str) -> Column:
    """True when a part of the repository-relative path is hidden or in the ignore list."""
    return col(path).rlike(IGNORED_REGEX)


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_dir(path: Column | str) -> Column:
    """Directory part; "." for files at the root."""
    p = col(path)
    return F.when(
        F.contains(p, F.lit("/")), F.left(p, F.length(p) - F.length(file_name(p)) - F.lit(1))
    ).otherwise(F.lit("."))


def suffix(path: Column | str) -> Column:
    """Last suffix with its dot as written, "" if none (".bashrc" and "x." have none)."""
    return F.regexp_extract(file_name(path), r"(?s)^.+([.][^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def full_path(directory: Column | str, name: Column | str) -> Column:
    d, n = col(directory), col(name)
    return F.when(d == ".", n).otherwise(F.concat_ws("/", d, n))


def ancestor_dirs(path: Column | str) -> Column:
    """Array of all directories above a path, outermost first; empty for root files."""
    parts = F.split(col(path), "/")
    depth = F.size(parts) - F.lit(1)
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def language_of(path: Column | str) -> Column:
    """Language the lines of a file count for; null when the extension is unknown."""
    pairs = ", ".join(f"'{ext}', '{language}'" for ext, language in fixed.LANGUAGE_OF_EXTENSION.items())
    return F.try_element_at(F.expr(f"map({pairs})"), F.lower(suffix(path)))


def listed_languages(path: Column | str) -> Column:
    """Array of the languages whose extension list has the file's suffix; null when none has."""
    by_ext: dict[str, list[str]] = {}
    for language, extensions in fixed.EXTENSIONS_OF_LANGUAGE.items():
        for ext in extensions:
            by_ext.setdefault(ext, []).append(language)
    names = {ext: ", ".join(f"'{name}'" for name in languages) for ext, languages in by_ext.items()}
    pairs = ", ".join(f"'{ext}', array({languages})" for ext, languages in names.items())
    return F.try_element_at(F.expr(f"map({pairs})"), F.lower(suffix(path)))


def is_binary_ext(path: Column | str) -> Column:
    return F.lower(suffix(path)).isin(fixed.SKIPPED_SUFFIXES)


def priority_stem(path: Column | str) -> Column:
    return F.lower(stem(path)).rlike(any_of(fixed.PRIORITY_WORDS))


def is_local_path(url: Column | str) -> Column:
    return ~col(url).rlike(r"^(https?://|git@|ssh://)")


def normalize_repo_url(url: Column | str) -> Column:
    """Key under which two addresses of one repository meet; dots, slashes and dashes become "_"."""
    low = F.lower(col(url))
    scp = F.when(
        low.startswith("git@"),
        F.replace(F.replace(low, F.lit("git@"), F.lit("")), F.lit(":"), F.lit("/")),
    ).otherwise(low)
    bare = F.when(scp.rlike("^https?://"), F.regexp_replace(scp, "https?://", "")).otherwise(scp)
    cut = F.regexp_replace(bare, r"[.]git\z", "")
    return F.translate(cut, "/-.", "___")
