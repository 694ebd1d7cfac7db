"""Profiles and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed
from repoquarry.operators import contents
from repoquarry.plans import profile, reports
from repoquarry.session import cut_lineage
from repoquarry.sources import sinks
from repoquarry.workload.content_queries import important
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs


def _profile(t: Inputs) -> DataFrame:
    return profile.repo_profile(t.files, t.commits, t.repos)


def _read(t: Inputs) -> DataFrame:
    """Facts of the contents, kept because reports use them more than once."""
    return cut_lineage(contents.read_contents(important(t), t.files).drop("content"))


@query(
    "repo_profile",
    """select p.repo_id, url as repo_url, branch, primary_language, total_files, total_commits, authors_count, last_commit,
              strftime(last_commit_date, '%Y-%m-%d %H:%M:%S') as last_commit_date, coalesce(languages, '') as languages
       from o_profile p left join (select repo_id, string_agg(language || '=' || line_count || '/' || file_count, ', ' order by rank) as languages
                                   from o_langs group by repo_id) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    shown = F.transform("languages", lambda e: F.concat(e["language"], F.lit("="), e["line_count"].cast("string"), F.lit("/"), e["file_count"].cast("string")))
    return _profile(t).select(
        "repo_id", "repo_url", "branch", "primary_language", "total_files", "total_commits", "authors_count", "last_commit",
        "last_commit_date", F.coalesce(F.array_join(shown, ", "), F.lit("")).alias("languages"),
    )


@query(
    "repository_info",
    """select p.repo_id, url, local_path, branch, last_commit, total_commits, array_to_string(authors, '|') as authors, languages
       from o_profile p left join (select repo_id, string_agg(language || '=' || line_count, ', ' order by language) as languages
                                   from o_lines group by repo_id) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    info = profile.repository_info(t.files, t.commits, t.repos)
    entries = F.sort_array(F.map_entries("languages"))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return info.withColumn("languages", F.array_join(shown, ", ")).withColumn("authors", F.array_join("authors", "|"))


@query("language_summary_text", "select repo_id, summary from o_summary")
def _(t: Inputs) -> DataFrame:
    return reports.language_summary_text(_profile(t))


@query(
    "search_context",
    """select repo_id, 'Repository: ' || url || chr(10) || 'Primary Language: ' || primary_language || chr(10) || chr(10) || summary || chr(10) as context
       from o_profile join o_summary using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    return reports.search_context(_profile(t))


@query(
    "profile_json",
    "select repo_id, url as repo_url, primary_language, total_files::varchar as total_files, total_commits::varchar as total_commits from o_profile",
)
def _(t: Inputs) -> DataFrame:
    written = sinks.profile_json(_profile(t))
    fields = ["repo_url", "primary_language", "total_files", "total_commits"]
    return written.select("repo_id", *[F.get_json_object("json", f"$.{f}").alias(f) for f in fields])


@query(
    "content_summary",
    """with h as (select repo_id, unnest(range(14)) as ordinal, unnest([
           '📄 File Content Summary', '==================', 'Total files: ' || total_files, 'Successfully read: ' || successful_reads,
           'Failed to read: ' || failed_reads, 'Total lines: ' || format('{:,}', total_lines), 'Total size: ' || format('{:,}', total_size_bytes) || ' bytes', '',
           '📊 By Importance Level:', '  Critical: ' || critical_files || ' files', '  High: ' || high_files || ' files',
           '  Medium: ' || medium_files || ' files', '', '📝 Readable Files:']) as line from o_stats)
       select repo_id, 0::bigint as section, ordinal, null::varchar as file_path, line from h
       union all
       select repo_id, 1, ordinal, file_path, case when is_readable then '  ✅ ' || file_path || ' (' || importance_level || ', ' || line_count || ' lines)'
              else '  ❌ ' || file_path || ' - ' || error_message end from o_read""",
)
def _(t: Inputs) -> DataFrame:
    return reports.content_summary(_read(t))


_NOTES = " || chr(10) || ".join("'" + n + "'" for n in fixed.OVERVIEW_NOTES)
_OVERVIEW = f"""
    with l as (select repo_id, string_agg('- **' || language || '**: ' || format('{{:,}}', line_count) || ' lines (' || printf('%.1f', round(percentage, 1)) || '%)',
                    chr(10) order by rank) as used from o_share group by repo_id),
    d as (select repo_id, string_agg('- **' || case dir when '.' then 'Root directory' else dir end || '**: ' || n || ' files', chr(10) order by dir) as listed
          from (select repo_id, dir, count(*) as n, row_number() over (partition by repo_id order by dir) as rank from o_tree group by repo_id, dir)
          where rank <= 10 group by repo_id),
    f as (select repo_id, string_agg('- `' || file_path || '` (' || importance_level || ') - ' || content_type, chr(10) order by pos) as shown
          from o_read where pos <= 15 and is_readable group by repo_id)
    select p.repo_id, '# Project Overview (Basic Analysis)' || chr(10) || chr(10) || '## Repository Information' || chr(10) || '**URL**: ' || url || chr(10)
      || '**Primary Language**: ' || primary_language || chr(10) || '**Total Files**: ' || p.total_files || chr(10) || '**Total Commits**: ' || total_commits || chr(10)
      || '**Contributors**: ' || authors_count || chr(10) || chr(10) || '## Languages Used' || chr(10) || used || chr(10) || chr(10) || '## Project Structure' || chr(10)
      || '### Directory Overview' || chr(10) || listed || chr(10) || chr(10) || '## File Analysis Summary' || chr(10)
      || '- **Total files analyzed**: ' || successful_reads || '/' || s.total_files || chr(10) || '- **Critical files**: ' || critical_files || chr(10)
      || '- **High importance files**: ' || high_files || chr(10) || '- **Medium importance files**: ' || medium_files || chr(10)
      || '- **Total lines analyzed**: ' || format('{{:,}}', total_lines) || chr(10) || chr(10) || '### Successfully Analyzed Files' || chr(10)
      || coalesce(shown || chr(10), '') || {_NOTES} as overview,
      url as repo_url, primary_language, successful_reads as total_files_analyzed, 'basic' as analysis_status,
      'Basic Repository Analysis' as analysis_method
    from o_profile p join l using (repo_id) join d using (repo_id) join o_stats s using (repo_id) left join f using (repo_id)"""


@query("basic_overview", _OVERVIEW)
def _(t: Inputs) -> DataFrame:
    return reports.basic_overview(_profile(t), t.files, _read(t))


@query("analyze_overview", _OVERVIEW)
def _(t: Inputs) -> DataFrame:
    return reports.analyze_overview(_profile(t), important(t), t.files)


@query(
    "fallback_overview",
    f"""with n as (select repo_id, string_agg(language, ', ' order by rank) as names from o_share group by repo_id),
       h as (select p.repo_id, unnest(range(13)) as ordinal, unnest(['# Project Overview (Basic Analysis)', '', '**Repository**: ' || url,
            '**Primary Language**: ' || primary_language, '**Languages**: ' || names, '**Files Analyzed**: ' || successful_reads || '/' || s.total_files, '',
            '## File Analysis Summary', '- Critical files: ' || critical_files, '- High importance files: ' || high_files,
            '- Medium importance files: ' || medium_files, '', '## Readable Files']) as line
          from o_profile p join n using (repo_id) join o_stats s using (repo_id)),
       e as (select repo_id, unnest(range(2)) as ordinal, unnest(['', '{fixed.FALLBACK_NOTE}']) as line from o_profile)
       select repo_id, 0::bigint as section, ordinal, null::varchar as file_path, line from h
       union all select repo_id, 1, ordinal, file_path, '- ' || file_path || ' (' || importance_level || ')' from o_read where is_readable
       union all select repo_id, 2, ordinal, null, line from e""",
)
def _(t: Inputs) -> DataFrame:
    return reports.fallback_overview(_profile(t), _read(t))


@query(
    "directory_text",
    """select repo_id, dir, case dir when '.' then 'Root directory:' else dir || '/:' end || chr(10)
              || string_agg('  - ' || name, chr(10) order by name) filter (where rank <= 10) || chr(10)
              || case when count(*) > 10 then '  ... and ' || (count(*) - 10) || ' more files' || chr(10) else '' end as text
       from (select repo_id, dir, name, row_number() over (partition by repo_id, dir order by name) as rank from o_tree) group by repo_id, dir""",
)
def _(t: Inputs) -> DataFrame:
    return reports.directory_text(t.files)


@query(
    "repo_card",
    """select p.repo_id, chr(10) || repeat('=', 60) || chr(10) || '📊 REPOSITORY ANALYSIS' || chr(10) || repeat('=', 60) || chr(10) || '📍 Repository URL: ' || url || chr(10)
         || '📁 Local Path: ' || local_path || chr(10) || '🌿 Current Branch: ' || branch || chr(10) || '📝 Total Commits: ' || total_commits || chr(10)
         || '🔄 Last Commit: ' || left(last_commit, 8) || '...' || chr(10) || '👥 Contributors (' || authors_count || '): ' || array_to_string(authors[1:5], ', ')
         || case when authors_count > 5 then chr(10) || '    ... and ' || (authors_count - 5) || ' more' else '' end
         || chr(10) || chr(10) || '💻 Programming Languages:' || chr(10) || listed as card
       from o_profile p join (select repo_id, string_agg('    (''' || language || ''', ' || line_count || ')', chr(10) order by rank) as listed
                              from o_share where rank <= 10 group by repo_id) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    return reports.repo_card(_profile(t))


@query(
    "insights",
    """select repo_id, 'Primary language is ' || primary_language || ' with ' || printf('%.1f', round(percentage, 1)) || '% coverage'
         || case when critical > 0 then chr(10) || 'Identified ' || critical || ' critical files essential for understanding the project' else '' end
         || case when high > 0 then chr(10) || 'Found ' || high || ' high-importance files containing key business logic' else '' end
         || chr(10) || 'Average classification confidence: ' || printf('%.1f', round(average * 100, 1)) || '%' as insights
       from o_profile join o_counts using (repo_id) join (select repo_id, percentage from o_share where rank = 1) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    return reports.insights(_profile(t), important(t)).withColumn("insights", F.array_join("insights", "\n"))


_RECOMMEND = " ".join(
    f"when lower(primary_language) in ({', '.join(chr(39) + n + chr(39) for n in names)}) then '{sentence}' || chr(10)"
    for names, sentence in fixed.LANGUAGE_RECOMMENDATIONS
)


@query(
    "recommendations",
    f"""select repo_id, rtrim(coalesce('Start documentation with critical files: ' || critical_files || chr(10), '') || case {_RECOMMEND} else '' end
          || case when has_config then '{fixed.CONFIG_RECOMMENDATION}' else '' end, chr(10)) as recommendations
        from o_profile join (
          select repo_id, string_agg(file_path, ', ' order by n) filter (where importance_level = 'CRITICAL' and n <= 3) as critical_files,
                 bool_or(contains(lower(file_path), 'config') or contains(lower(content_type), 'config')) as has_config
          from (select *, row_number() over (partition by repo_id, importance_level order by pos) as n from o_important) group by repo_id) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    return reports.recommendations(_profile(t), important(t)).withColumn("recommendations", F.array_join("recommendations", "\n"))


@query(
    "analysis_result",
    "select repo_id, n as important_count, round(overall, 9) as confidence_score from o_counts join o_profile using (repo_id)",
)
def _(t: Inputs) -> DataFrame:
    result = reports.analysis_result(_profile(t), important(t))
    return result.select("repo_id", "important_count", F.round("confidence_score", 9).alias("confidence_score"))


@query(
    "analyze_basic",
    f"""select repo_id, least(total_files, 15) as important_count,
               '{fixed.BASIC_INSIGHTS[0]}' || chr(10) || 'Identified ' || least(total_files, 15) || ' potentially important files' || chr(10)
               || 'Primary language: ' || primary_language || chr(10) || '{fixed.BASIC_INSIGHTS[1]}' as insights,
               {" || chr(10) || ".join("'" + r + "'" for r in fixed.BASIC_RECOMMENDATIONS)} as recommendations, 0.4::double as confidence_score
        from o_profile""",
)
def _(t: Inputs) -> DataFrame:
    result = reports.analyze_basic(_profile(t), t.files)
    return result.withColumns({c: F.array_join(c, "\n") for c in ("insights", "recommendations")})


@query(
    "project_analysis",
    """select repo_id, primary_language, total_commits, n as important_count, round(overall, 9) as confidence_score, successful_reads as total_files_analyzed
       from o_profile join o_counts using (repo_id) join (select repo_id, successful_reads from o_stats) using (repo_id)""",
)
def _(t: Inputs) -> DataFrame:
    whole = reports.project_analysis(_profile(t), important(t), t.files)
    return whole.select(
        "repo_id", "primary_language", "total_commits", "important_count", F.round("confidence_score", 9).alias("confidence_score"), "total_files_analyzed"
    )


@query(
    "important_files_report",
    """with s as (select *, case importance_level when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 end as level_rank from important_files)
       select repo_id, 0::bigint as level_rank, -1::bigint as ordinal, null::varchar as file_path, unnest(range(4)) as line_no,
              unnest(['# Important Files Analysis', '', '**Analysis Confidence**: ' || printf('%.1f', round(overall * 100, 1)) || '%', '']) as line from o_counts
       union all
       select repo_id, level_rank, -1, null, unnest(range(2)), unnest(['## ' || importance_level || ' Files', ''])
       from (select distinct repo_id, level_rank, importance_level from s where level_rank <= 3)
       union all
       select repo_id, level_rank, ordinal, file_path, unnest(range(5)), unnest(['### `' || file_path || '`', '- **Type**: ' || content_type,
              '- **Confidence**: ' || printf('%.1f', round(confidence_score::double * 100, 1)) || '%', '- **Reasons**: listed, ' || importance_level, ''])
       from s where level_rank <= 3""",
)
def _(t: Inputs) -> DataFrame:
    return reports.important_files_report(important(t)).withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))
