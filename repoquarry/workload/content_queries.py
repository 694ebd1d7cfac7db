"""Important files, their contents, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import answers, contents, importance
from repoquarry.session import cut_lineage
from repoquarry.sources import tables
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs


def important(t: Inputs) -> DataFrame:
    """Important files with reasons and line estimates, which the plain view leaves out."""
    return t.important_files.withColumn("confidence_score", F.col("confidence_score").cast("double")).withColumns(
        {"reasons": F.array(F.lit("listed"), F.col("importance_level")), "estimated_lines": F.lit(100)}
    )


@query(
    "join_contents",
    """select i.repo_id, i.file_path, i.ordinal, coalesce(f.path is not null, false) as found, coalesce(f.size, 0) as size, md5(f.content) as text_md5
       from important_files i left join files f on f.repo_id = i.repo_id and f.path = i.file_path""",
)
def _(t: Inputs) -> DataFrame:
    joined = contents.join_contents(t.important_files, t.files)
    return joined.select(
        "repo_id", "file_path", "ordinal", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("size", F.lit(0)).alias("size"), F.md5("content").alias("text_md5")
    )


@query(
    "read_contents",
    """select repo_id, file_path, importance_level, ordinal, md5(content) as text_md5, file_size_bytes, line_count, is_readable, error_message
       from o_read""",
)
def _(t: Inputs) -> DataFrame:
    read = contents.read_contents(important(t), t.files)
    return read.select(
        "repo_id", "file_path", "importance_level", "ordinal", F.md5("content").alias("text_md5"),
        "file_size_bytes", "line_count", "is_readable", "error_message",
    )


@query(
    "read_contents_guards",
    """select g.repo_id, g.file_path, case i % 7 when 0 then md5(text) when 3 then md5(repeat(md5(text) || chr(10), 1999) || md5(text) || chr(10) || chr(10) ||
                '... (truncated, showing first 2000 lines)') else md5('') end as text_md5,
              case when i % 7 in (4, 5, 6) then 0 else size end as file_size_bytes,
              case i % 7 when 0 then length(text) - length(replace(text, chr(10), '')) + 1 when 3 then 2000 else 0 end as line_count, i % 7 in (0, 3) as is_readable,
              case i % 7 when 1 then 'File too large: ' || size || ' bytes > 1048576 bytes' when 2 then 'Could not decode file content'
                         when 4 then 'Skipped binary/large file type: .PNG' when 5 then 'Path is not a file' when 6 then 'File does not exist' end as error_message
       from guard_important g join guard_files f on f.i = g.ordinal join documents on doc_id = i""",
)
def _(t: Inputs) -> DataFrame:
    """Every guard: too large, no text, too many lines, binary, a directory, missing."""
    read = contents.read_contents(t.guard_important, t.guard_files)
    return read.select("repo_id", "file_path", F.md5("content").alias("text_md5"), "file_size_bytes", "line_count", "is_readable", "error_message")


@query("content_stats", "select * from o_stats")
def _(t: Inputs) -> DataFrame:
    return contents.content_stats(contents.read_contents(important(t), t.files))


_EXISTS = "exists (select 1 from o_tree o where o.repo_id = i.repo_id and o.path = i.file_path)"


@query("existing_only", f"select repo_id, file_path, importance_level, ordinal from important_files i where {_EXISTS}")
def _(t: Inputs) -> DataFrame:
    return importance.existing_only(t.important_files, t.files).select("repo_id", "file_path", "importance_level", "ordinal")


@query("invented_paths", f"select repo_id, file_path, importance_level, ordinal from important_files i where not {_EXISTS}")
def _(t: Inputs) -> DataFrame:
    return importance.invented_paths(t.important_files, t.files).select("repo_id", "file_path", "importance_level", "ordinal")


@query("importance_counts", "select repo_id, critical, high, medium, low from o_counts")
def _(t: Inputs) -> DataFrame:
    return importance.importance_counts(t.important_files)


@query("avg_confidence", "select repo_id, round(average, 9) as avg_confidence from o_counts")
def _(t: Inputs) -> DataFrame:
    return importance.avg_confidence(important(t)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("overall_confidence", "select repo_id, round(overall, 9) as confidence_score from o_counts")
def _(t: Inputs) -> DataFrame:
    return importance.overall_confidence(important(t)).withColumn("confidence_score", F.round("confidence_score", 9))


_HEAD = """
    select repo_id, file_path, importance_level, ordinal from (
      select *, row_number() over (partition by repo_id, importance_level order by ordinal, file_path) as n from important_files)
    where importance_level in ('CRITICAL', 'HIGH') or (importance_level = 'MEDIUM' and n <= 5)"""


@query("head_per_level", _HEAD)
def _(t: Inputs) -> DataFrame:
    return contents.head_per_level(t.important_files).select("repo_id", "file_path", "importance_level", "ordinal")


@query("first_files", "select repo_id, file_path, pos as rank from o_important where pos <= 15")
def _(t: Inputs) -> DataFrame:
    return contents.first_files(t.important_files).select("repo_id", "file_path", "rank")


@query(
    "first_critical",
    """select repo_id, string_agg(file_path, ', ' order by n) as critical_paths from (
         select *, row_number() over (partition by repo_id order by pos) as n from o_important where importance_level = 'CRITICAL')
       where n <= 3 group by repo_id""",
)
def _(t: Inputs) -> DataFrame:
    return importance.first_critical(t.important_files).withColumn("critical_paths", F.array_join("critical_paths", ", "))


@query(
    "prompt_sections",
    """with r as (select *, row_number() over (partition by repo_id, importance_level order by ordinal, file_path) as n,
                    case importance_level when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 end as level_rank
             from o_read where is_readable)
       select distinct repo_id, level_rank::bigint as level_rank, 0::bigint as part, -1::bigint as ordinal, null::varchar as file_path,
              md5(case level_rank when 1 then '=== CRITICAL FILES ===' when 2 then chr(10) || '=== HIGH IMPORTANCE FILES ==='
                       else chr(10) || '=== MEDIUM IMPORTANCE FILES ===' end) as text_md5
       from r where level_rank is not null
       union all
       select repo_id, level_rank, 1, ordinal, file_path,
              md5(chr(10) || '--- FILE: ' || file_path || ' ---' || chr(10) || 'Importance: ' || importance_level || chr(10) || 'Type: ' || content_type || chr(10)
                || case when level_rank < 3 then 'Reasons: listed, ' || importance_level || chr(10) else '' end || 'Content:' || chr(10)
                || case when level_rank < 3 then content else left(content, 2000) end
                || case when level_rank = 3 and length(content) > 2000 then chr(10) || '... (content truncated)' else '' end
                || chr(10) || '--- END FILE ---' || chr(10))
       from r where level_rank < 3 or (level_rank = 3 and n <= 5)""",
)
def _(t: Inputs) -> DataFrame:
    sections = contents.prompt_sections(cut_lineage(contents.read_contents(important(t), t.files)))
    return sections.select(
        "repo_id", "level_rank", "part", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "file_path", F.md5("text").alias("text_md5")
    )


@query("read_responses", "select repo_id, cast(response_id as varchar) as response_id, md5(text) as text_md5 from responses where text is not null")
def _(t: Inputs) -> DataFrame:
    read = tables.read_responses(t.responses)
    return read.select("repo_id", F.col("response_id").cast("string").alias("response_id"), F.md5("text").alias("text_md5"))


# What the answers hold follows from the numbers they were made from, not from parsing them again.
_OBJECT = """'{"file_path": "src/f' || doc_id || '.py"' || case when doc_id % 4 = 0 then '' else ', "importance_level": "HIGH", "confidence_score": "0.5"' end || '}'"""


@query(
    "extract_fenced_json",
    f"""select lang as repo_id, doc_id as response_id, md5(case doc_id % 6 when 0 then '[' || {_OBJECT} || ', 3]' when 1 then '[' || {_OBJECT} || ']'
          when 2 then '{{"files": [' || {_OBJECT} || ']}}' when 3 then '{{"important_files": [' || {_OBJECT} || ']}}' when 4 then {_OBJECT}
          else 'The file src/f' || doc_id || '.py is CRITICAL' || chr(10) || '- entry point' || chr(10) end) as json_md5
        from documents""",
)
def _(t: Inputs) -> DataFrame:
    return t.responses.select("repo_id", "response_id", F.md5(answers.extract_fenced_json("text")).alias("json_md5"))


_PARSED = """
    select lang as repo_id, doc_id as response_id, 1::bigint as ordinal, 'src/f' || doc_id || '.py' as file_path,
           case when doc_id % 6 = 5 then 'CRITICAL' when doc_id % 4 = 0 then 'MEDIUM' else 'HIGH' end as importance_level,
           case when doc_id % 6 = 5 then 0.6::double when doc_id % 4 = 0 then 0.7::double else 0.5::double end as confidence_score,
           case when doc_id % 6 = 5 then 'entry point' else '' end as reasons,
           case when doc_id % 6 = 5 then 'Extracted from text analysis' else '' end as content_type,
           case when doc_id % 6 = 5 then 150::bigint else 100::bigint end as estimated_lines,
           case when doc_id % 6 = 5 then 'text' else 'json' end as source
    from documents"""


@query("parse_important_files", _PARSED)
def _(t: Inputs) -> DataFrame:
    return answers.parse_important_files(t.responses).withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "answer_fallback",
    "select lang as repo_id, case when doc_id % 6 = 5 then 'text' else 'json' end as source, count(*) as files from documents group by all",
)
def _(t: Inputs) -> DataFrame:
    return answers.parse_important_files(t.responses).groupBy("repo_id", "source").agg(F.count("*").alias("files"))


@query(
    "extract_files_from_text",
    f"select repo_id, response_id, ordinal, file_path, importance_level, confidence_score, reasons, content_type, estimated_lines from ({_PARSED}) where source = 'text'",
)
def _(t: Inputs) -> DataFrame:
    return answers.extract_files_from_text(t.responses).withColumn("reasons", F.array_join("reasons", "; "))
