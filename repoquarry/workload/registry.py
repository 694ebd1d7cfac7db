"""Registered queries: each reads the tables of one folder and has a DuckDB twin wherever SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.functions import fixed
from repoquarry.operators.patterns import CATALOGUE
from repoquarry.workload.views import VIEWS, Inputs, with_views


class Query(NamedTuple):
    run: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Inputs], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: 64-bit integers, timestamps as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain(entry.run(Inputs(spark, folder)))

    return {name: bind(entry) for name, entry in REGISTRY.items()}


def duckdb_queries() -> dict[str, str]:
    views = {**VIEWS, **ORACLE_VIEWS}
    return {name: with_views(entry.sql, views) for name, entry in REGISTRY.items() if entry.sql is not None}


def _values(rows: list[tuple], names: str) -> str:
    def literal(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({names})"


def sql_list(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _kind(pattern: str) -> str:
    if any(sign in pattern for sign in "\\^$*+?()|["):
        return "regex"
    return "dir" if pattern.endswith("/") else "name"


_LINES = "length(content) - length(replace(content, chr(10), '')) + case when content <> '' and right(content, 1) <> chr(10) then 1 else 0 end"
_SHARE = "printf('%.1f', round(percentage, 1))"

# Views of the DuckDB side only. They state the semantics a second time in SQL and share only fixed values with Spark.
ORACLE_VIEWS: dict[str, str] = {
    "o_ext": _values(list(fixed.LANGUAGE_OF_EXTENSION.items()), "ext, language"),
    "o_listed": _values([(k, e) for k, es in fixed.EXTENSIONS_OF_LANGUAGE.items() for e in es], "language, ext"),
    "o_catalogue": _values([(c, k, i, p, _kind(p)) for c, es in CATALOGUE.items() for i, (k, p) in enumerate(es)], "category, key, ordinal, pattern, kind"),
    "o_parts": """
        select *, case when strpos(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '.' end as dir,
               regexp_extract(path, '[^/]*$') as name,
               regexp_extract(regexp_extract(path, '[^/]*$'), '^.+([.][^.]+)$', 1) as suffix
        from files""",
    "o_all": f"""
        select p.*, left(name, length(name) - length(suffix)) as stem, language, {_LINES} as lines,
               len(list_filter(string_split(path, '/'), lambda x: x like '.%' or x in ({sql_list(fixed.IGNORED_PARTS)}))) > 0 as ignored
        from o_parts p left join o_ext e on e.ext = lower(suffix)""",
    "o_tree": "select * from o_all where not ignored",
    "o_lines": """
        select repo_id, language, cast(sum(lines) as bigint) as line_count from o_tree
        where language is not null and content is not null group by all""",
    "o_share": """
        select *, coalesce(line_count * 100.0::double / nullif(sum(line_count) over (partition by repo_id), 0), 0) as percentage,
               row_number() over (partition by repo_id order by line_count desc, language) as rank
        from o_lines""",
    "o_by_language": "select t.repo_id, l.language, path, stem from o_tree t join o_listed l on l.ext = lower(suffix)",
    "o_samples": f"""
        select * from (
          select *, row_number() over (partition by repo_id, language, late order by path) as n
          from (select *, not regexp_matches(lower(stem), '{'|'.join(fixed.PRIORITY_WORDS)}') as late from o_by_language))
        where n <= 5""",
    "o_langs": """
        select s.repo_id, s.language, s.line_count, coalesce(f.n, 0) as file_count, s.percentage, s.rank,
               coalesce(p.samples, []) as samples
        from o_share s
        left join (select repo_id, language, count(*) as n from o_by_language group by all) f using (repo_id, language)
        left join (select repo_id, language, list(path order by late, n) as samples from o_samples group by all) p
          using (repo_id, language)""",
    "o_log": "select *, row_number() over (partition by repo_id order by ts desc, commit_id desc) as pos from commits",
    "o_important": "select *, row_number() over (partition by repo_id order by ordinal, file_path) as pos from important_files",
    "o_dirs": "select distinct repo_id, dir from o_all",
    # Contents with the guards in order.
    "o_contents": f"""
        select i.*, f.content as raw, f.size as raw_size, f.suffix,
          case when f.path is null then 'File does not exist'
               when lower(f.suffix) in ({sql_list(fixed.SKIPPED_SUFFIXES)}) then 'Skipped binary/large file type: ' || f.suffix
               when f.size > 1048576 then 'File too large: ' || f.size || ' bytes > 1048576 bytes' end as error_message
        from o_important i left join o_all f on f.repo_id = i.repo_id and f.path = i.file_path""",
    "o_read": """
        select repo_id, file_path, importance_level, confidence_score, content_type, ordinal, pos, error_message,
               error_message is null as is_readable,
               case when error_message is null then raw else '' end as content,
               case when error_message like 'File does%' or error_message like 'Skipped%' then 0 else raw_size end as file_size_bytes,
               case when error_message is null then length(raw) - length(replace(raw, chr(10), '')) + 1 else 0 end as line_count
        from o_contents""",
    "o_stats": """
        select repo_id, count(*) as total_files, count(*) filter (where is_readable) as successful_reads,
               count(*) filter (where not is_readable) as failed_reads,
               cast(coalesce(sum(line_count) filter (where is_readable), 0) as bigint) as total_lines,
               cast(coalesce(sum(file_size_bytes) filter (where is_readable), 0) as bigint) as total_size_bytes,
               count(*) filter (where importance_level = 'CRITICAL') as critical_files,
               count(*) filter (where importance_level = 'HIGH') as high_files,
               count(*) filter (where importance_level = 'MEDIUM') as medium_files
        from o_read group by repo_id""",
    "o_counts": """
        select repo_id, count(*) as n, count(*) filter (where importance_level = 'CRITICAL') as critical,
               count(*) filter (where importance_level = 'HIGH') as high,
               count(*) filter (where importance_level = 'MEDIUM') as medium,
               count(*) filter (where importance_level = 'LOW') as low, avg(confidence_score)::double as average,
               least(avg(confidence_score)::double + least(count(*) filter (where importance_level = 'CRITICAL') * 0.1::double, 0.2::double), 1.0::double) as overall
        from important_files group by repo_id""",
    "o_recent_authors": "select repo_id, list_sort(list(distinct author)) as authors from o_log where pos <= 100 group by repo_id",
    "o_profile": """
        select r.repo_id, r.url, r.local_path, r.branch, coalesce(l.primary_language, 'Unknown') as primary_language, t.total_files,
               c.total_commits, a.authors, len(a.authors) as authors_count, c.last_commit, c.last_commit_date
        from repos r
        left join (select repo_id, language as primary_language from o_share where rank = 1) l using (repo_id)
        left join (select repo_id, count(*) as total_files from o_tree group by repo_id) t using (repo_id)
        left join (select repo_id, count(*) as total_commits, arg_min(cast(commit_id as varchar), pos) as last_commit, max(ts) as last_commit_date
                   from o_log group by repo_id) c using (repo_id)
        left join o_recent_authors a using (repo_id)""",
    "o_summary": f"""
        select repo_id, 'Primary Language: ' || max(language) filter (where rank = 1) || chr(10) || 'Total Languages: ' || count(*) || chr(10)
               || 'Total Code Files: ' || sum(file_count)::bigint || chr(10) || chr(10) || 'Language Breakdown:' || chr(10)
               || string_agg('- ' || language || ': ' || {_SHARE} || '% (' || format('{{:,}}', line_count) || ' lines, ' || file_count || ' files)'
                  || case when len(samples) > 0 and (rank <= 2 or (rank = 3 and early = 0))
                          then chr(10) || '  Sample files: ' || array_to_string(samples[1:3], ', ') else '' end, chr(10) order by rank)
                  filter (where rank <= 10) as summary
        from (select *, count(*) filter (where rank <= 2 and len(samples) > 0) over (partition by repo_id) as early from o_langs)
        group by repo_id""",
    "o_code": """
        select *, regexp_extract(path, '[^/]*$') as name,
               case when strpos(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '.' end as dir
        from code_files""",
    "o_hits": """
        select repo_id, path, category, key, pattern from o_code, o_catalogue
        where case kind when 'regex' then regexp_matches('/' || path, pattern) when 'name' then name = pattern
                        else strpos('/' || path, '/' || pattern) > 0 end""",
    "o_code_lang": """
        select c.*, e.language, len(list_filter(string_split(path, '/'), lambda x: x like '.%')) > 0 as ignored
        from o_code c left join o_ext e on e.ext = lower(regexp_extract(name, '^.+([.][^.]+)$', 1))""",
}
