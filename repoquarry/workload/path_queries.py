"""Paths, addresses, texts, classification and the pattern catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.functions import fixed, paths, text
from repoquarry.operators import importance, languages, patterns, repos, tree
from repoquarry.plans import profile
from repoquarry.sources.tree import file_tree
from repoquarry.workload.registry import query, sql_list
from repoquarry.workload.views import Inputs


@query("scan_files", "select repo_id, path, dir, name from o_tree")
def _(t: Inputs) -> DataFrame:
    return file_tree(t.files)


@query("is_ignored", "select repo_id, path, ignored from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select("repo_id", "path", paths.is_ignored("path").alias("ignored"))


@query("full_path", "select repo_id, path from o_tree")
def _(t: Inputs) -> DataFrame:
    return tree.flatten_index(tree.directory_index(t.files, page_size=50))


@query("path_parts", "select repo_id, path, dir, name, suffix, stem from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select(
        "repo_id", "path", paths.parent_dir("path").alias("dir"), paths.file_name("path").alias("name"),
        paths.suffix("path").alias("suffix"), paths.stem("path").alias("stem"),
    )


@query("language_of", "select repo_id, path, language from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select("repo_id", "path", paths.language_of("path").alias("language"))


@query("is_local_path", "select id, url, not regexp_matches(url, '^(http://|https://|git@|ssh://)') as is_local from repo_urls")
def _(t: Inputs) -> DataFrame:
    return t.repo_urls.select("id", "url", paths.is_local_path("url").alias("is_local"))


_KEY = """
    select id, url, regexp_replace(regexp_replace(
      case when regexp_matches(u, '^https?://') then regexp_replace(u, 'https?://', '', 'g') else u end, '[.]git$', ''),
      '[/.-]', '_', 'g') as repo_key
    from (select id, url, case when lower(url) like 'git@%' then replace(replace(lower(url), 'git@', ''), ':', '/') else lower(url) end as u
          from repo_urls)"""


@query("normalize_repo_url", f"select id, repo_key from ({_KEY})")
def _(t: Inputs) -> DataFrame:
    return t.repo_urls.select("id", paths.normalize_repo_url("url").alias("repo_key"))


@query("dedupe_repos", f"select repo_key, min(id) as id, arg_min(url, id) as url, count(*) as addresses from ({_KEY}) group by repo_key")
def _(t: Inputs) -> DataFrame:
    return repos.dedupe_repos(t.repo_urls)


@query("is_binary_ext", f"select repo_id, path, lower(suffix) in ({sql_list(fixed.SKIPPED_SUFFIXES)}) as is_binary from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select("repo_id", "path", paths.is_binary_ext("path").alias("is_binary"))


@query("line_count", "select repo_id, path, lines, len(string_split(content, chr(10))) as split_lines from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select(
        "repo_id", "path", text.line_count("content").alias("lines"), text.split_line_count("content").alias("split_lines")
    )


@query("decode_text", "select repo_id, path, md5(content) as text_md5, length(content) as characters from files")
def _(t: Inputs) -> DataFrame:
    decoded = t.files.select("repo_id", "path", text.decode_text(F.encode("content", "UTF-8")).alias("text"))
    return decoded.select("repo_id", "path", F.md5("text").alias("text_md5"), F.length("text").alias("characters"))


@query(
    "truncate_lines",
    """select repo_id, path, md5(case when len(l) > 5 then array_to_string(l[1:5], chr(10)) || chr(10) || chr(10) || '... (truncated, showing first 5 lines)'
              else content end) as text_md5, least(len(l), 5) as lines
       from (select *, string_split(content, chr(10)) as l from files)""",
)
def _(t: Inputs) -> DataFrame:
    return t.files.select(
        "repo_id", "path", F.md5(text.truncate_lines("content", 5)).alias("text_md5"),
        text.truncated_line_count("content", 5).alias("lines"),
    )


@query("short_hash", "select repo_id, commit_id, left(md5(cast(commit_id as varchar)), 8) as short from commits")
def _(t: Inputs) -> DataFrame:
    return t.commits.select("repo_id", "commit_id", text.short_hash(F.md5(F.col("commit_id").cast("string"))).alias("short"))


@query("message_headline", "select repo_id, commit_id, left(string_split(message, chr(10))[1], 80) as headline from commits")
def _(t: Inputs) -> DataFrame:
    return t.commits.select("repo_id", "commit_id", text.message_headline("message").alias("headline"))


@query("strip_text", "select conv_id, turn, md5(regexp_replace(chr(9) || text || chr(10) || ' ', '^\\s+|\\s+$', '', 'g')) as text_md5 from conversations")
def _(t: Inputs) -> DataFrame:
    padded = F.concat(F.lit("\t"), "text", F.lit("\n "))
    return t.conversations.select("conv_id", "turn", F.md5(text.strip_text(padded)).alias("text_md5"))


_README = """
    (select concat('d', cast(cast(floor(doc_id / 4) as bigint) as varchar(20))) as repo_id,
            case doc_id % 4 when 0 then 'README' when 1 then 'docs/README.md' when 2 then 'README.txt' else 'README.md' end as path,
            text as content, doc_id
     from documents) d"""


@query(
    "repo_description",
    f"""select repo_id, left(array_to_string(list_filter(list_transform(string_split(content, chr(10))[1:10],
                lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and not starts_with(x, '#'))[1:3], ' '), 500) as repo_description
        from (select *, row_number() over (partition by repo_id order by case path when 'README.md' then 1 when 'README.txt' then 3 else 4 end) as n
              from {_README} where path <> 'docs/README.md') where n = 1""",
)
def _(t: Inputs) -> DataFrame:
    readmes = t.spark.sql(
        f"select repo_id, path, content from {_README.replace('from documents', 'from {documents}')}", documents=t.documents
    )
    return profile.repo_description(readmes)


@query("priority_stem", f"select repo_id, path, regexp_matches(lower(stem), '{'|'.join(fixed.PRIORITY_WORDS)}') as is_priority from o_all")
def _(t: Inputs) -> DataFrame:
    return t.files.select("repo_id", "path", paths.priority_stem("path").alias("is_priority"))


@query(
    "languages_list",
    """select repo_id, string_agg(language || ' (' || printf('%.1f', round(percentage, 1)) || '%)', ', ' order by rank) as languages_list
       from o_share group by repo_id""",
)
def _(t: Inputs) -> DataFrame:
    return languages.languages_list(languages.with_share(languages.language_lines(t.files)))


def _basic(field: int) -> str:
    whens = " ".join(
        f"when {' or '.join(f'contains(lower(path), {chr(39)}{w}{chr(39)})' for w in rule[3])} then '{rule[field]}'"
        for rule in fixed.BASIC_RULES
    )
    default = {0: 0, 1: 1, 2: 2}[field]
    return f"case {whens} else '{fixed.BASIC_DEFAULT[default]}' end"


@query(
    "classify_basic",
    f"""select repo_id, path as file_path, {_basic(0)} as importance_level, {_basic(1)} as content_type, {_basic(2)} as reason,
               0.5::double as confidence_score, 100::bigint as estimated_lines, ordinal
        from (select *, row_number() over (partition by repo_id order by path) as ordinal from o_tree) where ordinal <= 15""",
)
def _(t: Inputs) -> DataFrame:
    found = importance.classify_basic(t.files)
    return found.withColumn("reason", F.array_join("reasons", "; ")).drop("reasons")


@query(
    "basic_class",
    f"select repo_id, path, {_basic(0)} as importance_level, {_basic(1)} as content_type, {_basic(2)} as reason from code_files",
)
def _(t: Inputs) -> DataFrame:
    return t.code_files.select("repo_id", "path", importance.basic_class("path").alias("c")).select("repo_id", "path", "c.*")


@query(
    "match_patterns",
    "select c.repo_id, c.path, "
    + ", ".join(f"coalesce(bool_or(category = '{c}'), false) as {n}" for n, c in patterns.FLAGS.items())
    + " from code_files c left join o_hits h on h.repo_id = c.repo_id and h.path = c.path group by c.repo_id, c.path",
)
def _(t: Inputs) -> DataFrame:
    return patterns.match_patterns(t.code_files)


@query("explain_pattern", "select repo_id, path, category, key, pattern from o_hits")
def _(t: Inputs) -> DataFrame:
    return patterns.explain_pattern(t.code_files)


@query(
    "entry_point_patterns",
    """select l.repo_id, l.language, c.ordinal, c.pattern from (select distinct repo_id, language from o_code_lang where language is not null) l
       join o_catalogue c on c.category = 'entry_points' and c.key = lower(l.language)""",
)
def _(t: Inputs) -> DataFrame:
    found = t.code_files.select("repo_id", paths.language_of("path").alias("language")).filter("language is not null").distinct()
    offered = [patterns.entry_point_patterns(t.spark, k.upper()).withColumn("key", F.lit(k)) for k in fixed.ENTRY_POINTS]
    return found.join(reduce(DataFrame.unionByName, offered), F.lower("language") == F.col("key")).select("repo_id", "language", "ordinal", "pattern")


def _pattern_counts(t: Inputs, category: str, looked_up: DataFrame) -> DataFrame:
    """Files per repository for each pattern of a lookup `(key, ordinal, pattern)`."""
    hits = patterns.explain_pattern(t.code_files).filter(F.col("category") == category)
    counts = hits.groupBy("repo_id", "key", "pattern").agg(F.count("*").alias("files"))
    return counts.join(looked_up, ["key", "pattern"]).select("repo_id", "key", "ordinal", "pattern", "files")


_COUNTS = """select repo_id, key, ordinal, pattern, count(*) as files from o_hits join o_catalogue c using (category, key, pattern)
             where category = '{}' group by all"""


@query("config_patterns", _COUNTS.format("config_files"))
def _(t: Inputs) -> DataFrame:
    return _pattern_counts(t, "config_files", patterns.config_patterns(t.spark).withColumn("key", F.lit("")))


@query("test_patterns", _COUNTS.format("test_files"))
def _(t: Inputs) -> DataFrame:
    return _pattern_counts(t, "test_files", patterns.test_patterns(t.spark).withColumn("key", F.lit("")))


@query("framework_patterns", _COUNTS.format("framework_files"))
def _(t: Inputs) -> DataFrame:
    looked_up = [patterns.framework_patterns(t.spark, k).withColumn("key", F.lit(k)) for k in fixed.FRAMEWORK_FILES]
    return _pattern_counts(t, "framework_files", reduce(DataFrame.unionByName, looked_up))


@query(
    "patterns_for_language",
    """select l.language, c.category, c.key, c.ordinal, c.pattern from (select distinct language from o_lines) l
       join o_catalogue c on (c.category = 'entry_points' and c.key = lower(l.language))
         or c.category in ('config_files', 'test_files', 'build_files', 'framework_files', 'doc_files')""",
)
def _(t: Inputs) -> DataFrame:
    return patterns.patterns_for_language(languages.language_lines(t.files).select("language").distinct())


@query("language_extensions", "select l.language, l.ext, count(*) as files from o_tree join o_listed l on l.ext = lower(suffix) group by all")
def _(t: Inputs) -> DataFrame:
    exts = t.files.filter(~paths.is_ignored("path")).groupBy(F.lower(paths.suffix("path")).alias("ext")).agg(F.count("*").alias("files"))
    return patterns.language_extensions(t.spark).join(exts, "ext").select("language", "ext", "files")


@query(
    "detect_frameworks",
    """select repo_id, key as framework, count(distinct pattern) as patterns_found, count(*) as hits
       from o_hits where category = 'framework_files' group by all""",
)
def _(t: Inputs) -> DataFrame:
    return patterns.detect_frameworks(t.code_files)
