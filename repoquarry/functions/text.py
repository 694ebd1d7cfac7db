"""Column functions on text: line counts, cuts, stripping, number rendering."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions import fixed
from repoquarry.functions.paths import col

# Whitespace as str.strip() knows it: Unicode white space and the four separators U+001C..U+001F.
_SPACE = r"[\s\x1c-\x1f]"


def unix_lines(text: Column | str) -> Column:
    """The text with "\\r\\n" and "\\r" turned into "\\n", untouched when it has none."""
    t = col(text)
    return F.when(
        F.contains(t, F.lit("\r")), F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    ).otherwise(t)


def _newlines(unix: Column) -> Column:
    return (F.octet_length(unix) - F.octet_length(F.replace(unix, F.lit("\n"), F.lit("")))).cast("bigint")


def line_count(text: Column | str) -> Column:
    """Lines as an iterating reader sees them: an unfinished last line counts, a final newline adds none."""
    unix = unix_lines(text)
    tail = (F.octet_length(unix) > 0) & ~F.endswith(unix, F.lit("\n"))
    return _newlines(unix) + tail.cast("bigint")


def split_line_count(text: Column | str) -> Column:
    """Pieces after splitting at newlines: a final newline adds one, empty text is one."""
    return _newlines(unix_lines(text)) + F.lit(1).cast("bigint")


def decode_text(data: Column | str) -> Column:
    """Bytes as UTF-8 with invalid sequences replaced; null stays null."""
    return F.make_valid_utf8(col(data).cast("string"))


def truncate_lines(text: Column | str, limit: int = fixed.MAX_CONTENT_LINES) -> Column:
    unix = unix_lines(text)
    marker = f"\n\n... (truncated, showing first {limit} lines)"
    return F.when(
        _newlines(unix) >= limit, F.concat(F.substring_index(unix, "\n", limit), F.lit(marker))
    ).otherwise(unix)


def truncated_line_count(text: Column | str, limit: int = fixed.MAX_CONTENT_LINES) -> Column:
    """Line count of the text kept by `truncate_lines`, without the marker."""
    return F.least(split_line_count(text), F.lit(limit).cast("bigint"))


def short_hash(commit_id: Column | str) -> Column:
    return F.left(col(commit_id).cast("string"), F.lit(8))


def message_headline(message: Column | str) -> Column:
    return F.left(F.substring_index(col(message), "\n", 1), F.lit(80))


def strip_text(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def percent(value: Column | str) -> Column:
    """One decimal, half up, without the sign."""
    return F.format_string("%.1f", F.round(col(value), 1))


def grouped(value: Column | str) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col(value).cast("bigint"), 0)


def lines_text(*lines: Column) -> Column:
    """Text of the given lines; null lines are left out, empty ones stay."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def fill(template: str, **values: Column | str) -> Column:
    """The template with its {names} replaced by columns."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(col(values[name]).cast("string"))
    return F.concat(*parts)


def fill_lines(template: str, **values: Column | str) -> Column:
    """The filled template as an array of lines."""
    return F.split(fill(template, **values), "\n", -1)


def description_of(text: Column | str) -> Column:
    """Up to three non-blank, non-heading lines among the first ten, as one text of at most 500 characters."""
    # Ten cuts are enough; the rest of a long text stays one piece that is dropped.
    head = F.transform(F.slice(F.split(unix_lines(text), "\n", 11), 1, 10), strip_text)
    kept = F.filter(head, lambda line: (line != "") & ~line.startswith("#"))
    return F.left(F.array_join(F.slice(kept, 1, 3), " "), F.lit(500))
