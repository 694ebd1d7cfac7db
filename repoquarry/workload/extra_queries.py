"""Chunks, retrieval, search, dependencies, quality, trends, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import chunks, dependencies, languages, quality, search
from repoquarry.streaming import change_counts
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs


@query(
    "chunk_text",
    """select repo_id, path, language, k as chunk_no, k * 1800 + 1 as start, md5(substr(content, k * 1800 + 1, 2000)) as chunk_md5
       from (select repo_id, path, language, content, unnest(range(greatest(1, cast(ceil((length(content) - 200) / 1800.0) as bigint)))) as k
             from o_all where length(content) > 0)""",
)
def _(t: Inputs) -> DataFrame:
    cut = chunks.chunk_text(t.files)
    return cut.select("repo_id", "path", "language", "chunk_no", "start", F.md5("chunk").alias("chunk_md5"))


def _cut_sql(pieces: str, behind: str) -> str:
    return f"flatten(list_transform({pieces}, lambda p: case when length(p) <= 2000 then [p] else list_filter(regexp_extract_all(p, '{behind}'), lambda x: x <> '') end))"


_PIECES = _cut_sql(_cut_sql(_cut_sql(_cut_sql("[content]", "(?s).*?(?:\\n\\n|\\z)"), "(?s).*?(?:\\n|\\z)"), "(?s).*?(?: |\\z)"), "(?s).{1,1000}.{0,1000}")


@query(
    "split_recursive",
    f"""with p as (select repo_id, path, language, {_PIECES} as pieces from o_all where length(content) > 0),
        c as (select repo_id, path, language, string_split(list_reduce(pieces, lambda s, p:
                case when length(string_split(s, chr(57344))[-1]) + length(p) <= 2000 then s || p else s || chr(57344) || p end), chr(57344)) as chunks from p),
        n as (select repo_id, path, language, chunks, unnest(range(len(chunks))) as chunk_no from c)
        select repo_id, path, language, chunk_no, coalesce(list_sum(list_transform(chunks[1:chunk_no], lambda x: length(x))), 0)::bigint + 1 as start, md5(chunks[chunk_no + 1]) as chunk_md5 from n""",
)
def _(t: Inputs) -> DataFrame:
    cut = chunks.split_recursive(t.files)
    return cut.select("repo_id", "path", "language", "chunk_no", "start", F.md5("chunk").alias("chunk_md5"))


SIMILAR_TWIN = """with e as (select label::bigint as repo_id, vec_id, embedding::double[] as v from embeddings),
       c as (select repo_id, list(x order by i) as q from (
               select repo_id, i, avg(v[i]) as x from e, (select unnest(range(1, 65)) as i) group by all) group by repo_id)
       select repo_id, 'centroid' as query_id, rank, vec_id as chunk_id, similarity from (
         select *, row_number() over (partition by repo_id order by similarity desc, vec_id) as rank
         from (select e.repo_id, vec_id, round(list_cosine_similarity(v, q), 6) as similarity from e join c using (repo_id)))
       where rank <= 10"""


@query("top_k_similar", SIMILAR_TWIN)
def _(t: Inputs) -> DataFrame:
    """Labels stand for repositories; each is asked for the vectors nearest to its mean."""
    stored = t.embeddings.selectExpr("label as repo_id", "vec_id as chunk_id", "embedding as vector")
    asked = chunks.centroids(stored).withColumn("query_id", F.lit("centroid"))
    return chunks.top_k_similar(stored, asked, 10)


SEARCH_TERMS = ["the", "and", "que", "der", "les"]
SEARCH_TWIN = f"""with w as (select repo_id, path, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'),
                     lambda x: x in ({", ".join("'" + x + "'" for x in SEARCH_TERMS)}))) as term from files),
        p as (select repo_id, path, term, count(*) as tf from w group by all),
        i as (select p.repo_id, term, ln(1 + any_value(n)::double / count(*)) as idf from p
              join (select repo_id, count(*) as n from files group by repo_id) s using (repo_id) group by p.repo_id, term)
        select repo_id, rank, path, score from (
          select *, row_number() over (partition by repo_id order by score desc, path) as rank from (
            select repo_id, path, round(sum(tf * idf), 6) as score from p join i using (repo_id, term) group by all)) where rank <= 10"""


@query("search_docs", SEARCH_TWIN)
def _(t: Inputs) -> DataFrame:
    return search.search_docs(t.files, SEARCH_TERMS)


@query(
    "term_index",
    """select repo_id, term, path, count(*) as tf from (
         select repo_id, path, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as term from files)
       group by all""",
)
def _(t: Inputs) -> DataFrame:
    return search.term_index(t.files)


_N = "cast(i % 40 as varchar)"


@query(
    "dependency_manifest",
    f"""with m as (select repo_id, path, {_N} as n, i % 16 as k from code_paths where path not like '.%')
        select repo_id, path, 'python' as ecosystem, 'flask' as package, '==' || n || '.1' as version from m where k = 0
        union all select repo_id, path, 'python', 'numpy', '>= 1.' || n from m where k = 0
        union all select repo_id, path, 'javascript', 'react', '^' || n || '.0' from m where k = 1
        union all select repo_id, path, 'javascript', 'jest', '1.' || n from m where k = 1
        union all select repo_id, path, 'go', 'example.com/dep' || n, 'v1.' || n || '.0' from m where k = 8
        union all select repo_id, path, 'rust', 'serde', '1.' || n from m where k = 9
        union all select repo_id, path, 'java', 'g' || n || ':core', '2.' || n from m where k = 10""",
)
def _(t: Inputs) -> DataFrame:
    return dependencies.dependency_manifest(t.code_files)


@query(
    "import_edges",
    f"""with m as (select repo_id, path, i, {_N} as n, i % 16 as k from code_paths where path not like '.%'),
        e as (select repo_id, path, n, 'Python' as language, unnest(['os', 'sys', 'm' || (i + 9) || '.settings', 'm' || (i + 9) || '.settings.x']) as module from m where k = 2
              union all select repo_id, path, n, 'TSX', unnest(['react', '../m' || (i + 4)]) from m where k = 3
              union all select repo_id, path, n, 'Java', unnest(['java.util.List', 'a.b' || n || '.C']) from m where k = 4
              union all select repo_id, path, n, 'Python', 'pytest' from m where k = 5
              union all select repo_id, path, n, 'JavaScript', 'lib' || n from m where k = 7
              union all select repo_id, path, n, 'Python', unnest(['a.b', 'd']) from m where k = 11
              union all select repo_id, path, n, 'TypeScript', 'vitest' from m where k = 13
              union all select repo_id, path, n, 'Go', unnest(['fmt', 'example.com/dep' || n]) from m where k = 14
              union all select repo_id, path, n, 'C', unnest(['stdio.h', 'm' || n || '.h']) from m where k = 15)
        select repo_id, path, language, module from e""",
)
def _(t: Inputs) -> DataFrame:
    return dependencies.import_edges(t.code_files)


# Which file of a small project imports which, by their places in the view.
_POLY_EDGES = [
    (2, 1), (3, 2), (4, 2), (5, 1), (5, 2), (9, 7), (11, 10), (12, 10), (13, 10), (14, 10), (16, 17), (16, 18),
    (16, 20), (16, 19), (19, 20), (20, 17), (21, 18), (23, 22), (25, 24), (27, 26), (29, 28), (29, 30), (31, 32),
]

_FILE_EDGES = f"""
    select distinct a.repo_id, a.path as src, b.path as dst from code_paths a join code_paths b on a.repo_id = b.repo_id
    where a.path not like '.%' and b.path not like '.%' and ((a.i % 16 = 2 and b.i = a.i + 9)
          or (a.i % 16 = 3 and b.i = a.i + 4 and regexp_replace(a.path, 'm[0-9]+/[^/]*$', '') = regexp_replace(b.path, 'm[0-9]+/[^/]*$', '')))
    union all
    select a.repo_id, a.path, b.path from poly_paths a join poly_paths b on a.w = b.w
    join (values {", ".join(map(str, _POLY_EDGES))}) e(s, d) on a.k = e.s and b.k = e.d"""


def _sources(t: Inputs) -> DataFrame:
    return t.code_files.unionByName(t.poly_files)


@query("file_edges", _FILE_EDGES)
def _(t: Inputs) -> DataFrame:
    return dependencies.file_edges(dependencies.import_edges(_sources(t)), _sources(t))


@query(
    "change_impact_from_code",
    f"""with recursive e as ({_FILE_EDGES}),
       s as (select repo_id, path from code_paths where i % 16 in (7, 11) union all select repo_id, path from poly_paths where k in (1, 17, 7)),
       r as (select repo_id, path, 0 as depth from s union select e.repo_id, e.src, depth + 1 from r join e on e.repo_id = r.repo_id and e.dst = r.path where depth < 9)
       select repo_id, path, min(depth)::bigint as depth from r group by all""",
)
def _(t: Inputs) -> DataFrame:
    """All settings modules and scripts changed, and the files at the end of chains of imports; their importers are found in the texts."""
    changed = t.code_paths.filter((F.col("i") % 16).isin(7, 11)).select("repo_id", "path")
    ends = t.poly_paths.filter(F.col("k").isin(1, 17, 7)).select("repo_id", "path")
    return dependencies.impact_from_code(changed.unionByName(ends), _sources(t))


@query(
    "change_impact",
    """with recursive s as (select repo_id, path, i from code_paths where case when repo_id = 'r5' then i > 600 else strpos(path, 'src/') = 1 end),
       r as (select repo_id, path, 0 as depth from s
             union select e.repo_id, e.src, depth + 1 from r join code_edges e on e.repo_id = r.repo_id and e.dst = r.path)
       select repo_id, path, min(depth)::bigint as depth from r group by all""",
)
def _(t: Inputs) -> DataFrame:
    """Everything below src/ counts as changed; in r5, whose files import each other in one long chain, only its far end."""
    changed = t.code_paths.filter(F.when(F.col("repo_id") == "r5", F.col("i") > 600).otherwise(F.col("path").startswith("src/"))).select("repo_id", "path")
    return dependencies.change_impact(changed, t.code_edges)


@query(
    "docs_to_refresh",
    """select repo_id, report_id, count(*) as inputs, count(*) filter (where changed_at > built_at) as stale_inputs,
              strftime(max(changed_at), '%Y-%m-%d %H:%M:%S') as last_change
       from reports left join (select repo_id, file_path, max(ts) as changed_at from file_changes group by all) c using (repo_id, file_path) group by all""",
)
def _(t: Inputs) -> DataFrame:
    return dependencies.docs_to_refresh(t.reports, t.file_changes)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# The same as the lookarounds of the kind, for an engine without them; twice, as two addresses may share what stands between them.
_ADDRESS = f"(^|[^0-9.]|(?:^|[^0-9])[.]){_OCTET}(?:[.]{_OCTET}){{3}}($|[^0-9.]|[.](?:$|[^0-9]))"


def _mask_steps(value: str) -> list[tuple[str, str]]:
    """Each kind with the text after it."""
    steps = []
    for kind, regex in quality.SENSITIVE.items():
        for _ in range(2 if kind == "ipv4" else 1):
            found, put = (_ADDRESS, "\\1[IPV4]\\2") if kind == "ipv4" else (regex, f"[{kind.upper()}]")
            value = f"regexp_replace({value}, '{found}', '{put}', 'g')"
        steps.append((kind, value))
    return steps


# Texts that hold one passage each, and what masking makes of them; `n` is a number of the row.
_LEAKS = [
    ("'curl -H \"Authorization: Bearer abc.DEF' || n || '0123456789\"'", "'curl -H \"Authorization: [AUTHORIZATION]\"'", "authorization"),
    ("'git clone https://u' || n || ':s3cretpw@host.example/x.git'", "'git clone [URL_PASSWORD]host.example/x.git'", "url_password"),
    ("'export T=github_pat_11AAAAAAA0' || n || 'bcdefghijklmn'", "'export T=[TOKEN]'", "token"),
    ("'release 1.2.3.4.' || n || ' and 300.1.1.' || n", "'release 1.2.3.4.' || n || ' and 300.1.1.' || n", None),
    ("'{\"password\": \"hunter22' || n || '\"}'", "'{[ASSIGNED_SECRET]}'", "assigned_secret"),
    ("'ping 10.0.0.' || n || '.'", "'ping [IPV4].'", "ipv4"),
    ("'const api_key = \"a b c ' || n || '\";'", "'const [ASSIGNED_SECRET];'", "assigned_secret"),
    ("'mail a.b' || n || '@example.org now'", "'mail [EMAIL] now'", "email"),
]


def _leaks(t: Inputs) -> DataFrame:
    """Each part with one of the texts."""
    content = F.lit(None).cast("string")
    for kind, (text, _, _) in enumerate(_LEAKS):
        content = F.when(F.col("i") % len(_LEAKS) == kind, F.expr(text)).otherwise(content)
    numbered = t.code_paths.select("repo_id", F.concat(F.lit("leak/"), "path").alias("path"), "i", (F.col("i") % 100).cast("string").alias("n"))
    return numbered.select("repo_id", "path", content.alias("content"))


_LEAK_ROWS = "select repo_id, 'leak/' || path as path, i % {count} as kind, (i % 100)::varchar as n from code_paths".format(count=len(_LEAKS))


@query(
    "mask_sensitive",
    f"select repo_id, path, md5({_mask_steps('content')[-1][1]}) as text_md5 from (select repo_id, path, content from files union all select repo_id, path, content from code_files)"
    f" union all select repo_id, path, md5(case kind {' '.join(f'when {k} then {masked}' for k, (_, masked, _) in enumerate(_LEAKS))} end) from ({_LEAK_ROWS})",
)
def _(t: Inputs) -> DataFrame:
    texts = t.files.select("repo_id", "path", "content").unionByName(t.code_files.select("repo_id", "path", "content")).unionByName(_leaks(t))
    return quality.mask_sensitive(texts).select("repo_id", "path", F.md5("content").alias("text_md5"))


def _findings_sql() -> str:
    """Marks of a kind that its step puts in."""
    parts, before = [], "content"
    for kind, after in _mask_steps("content"):
        mark = f"[{kind.upper()}]"
        count = lambda v: f"(length({v}) - length(replace({v}, '{mark}', ''))) // {len(mark)}"  # noqa: E731, B023
        parts.append(f"select repo_id, path, '{kind}' as kind, {count(after)} - {count(before)} as findings from u")
        before = after
    leaks = f"select repo_id, path, case kind {' '.join(f'when {k} then {chr(39) + kind + chr(39)}' for k, (_, _, kind) in enumerate(_LEAKS) if kind)} end as kind, 1 as findings from ({_LEAK_ROWS})"
    texts = "select repo_id, path, content from files union all select repo_id, path, content from code_files"
    return f"with u as ({texts}) select * from (" + " union all ".join(parts) + f") where findings > 0 union all select * from ({leaks}) where kind is not null"


@query("sensitive_findings", _findings_sql())
def _(t: Inputs) -> DataFrame:
    texts = t.files.select("repo_id", "path", "content").unionByName(t.code_files.select("repo_id", "path", "content")).unionByName(_leaks(t))
    return quality.sensitive_findings(texts)


@query(
    "doc_coverage",
    """with f as (select c.repo_id, c.dir, c.path, c.language is not null as known, exists (select 1 from o_hits h where h.category = 'doc_files' and h.repo_id = c.repo_id and h.path = c.path) as is_doc
                  from o_code_lang c where not ignored),
       d as (select repo_id, dir, bool_or(is_doc) as documented, count(*) filter (where known and not is_doc) as code_files from f group by all)
       select repo_id, count(*) as directories, count(*) filter (where documented) as documented_directories, avg(documented::int) as directory_coverage,
              coalesce(sum(case when documented then code_files else 0 end)::double / nullif(sum(code_files), 0), 0) as file_coverage
       from d group by repo_id""",
)
def _(t: Inputs) -> DataFrame:
    return quality.doc_coverage(t.code_files)


@query(
    "test_share",
    """select repo_id, count(*) filter (where t) as test_files, count(*) filter (where not t) as source_files,
              count(*) filter (where t)::double / nullif(count(*) filter (where not t), 0) as tests_per_source
       from (select c.repo_id, exists (select 1 from o_hits h where h.category = 'test_files' and h.repo_id = c.repo_id and h.path = c.path) as t
             from o_code_lang c where not ignored and language is not null) group by repo_id""",
)
def _(t: Inputs) -> DataFrame:
    return quality.test_share(t.code_files)


_DEBT = """
    select * from (select repo_id, path, coalesce(language, 'Other') as language, len(regexp_extract_all(content, '\\bTODO\\b')) as todo,
           len(regexp_extract_all(content, '\\bFIXME\\b')) as fixme, len(regexp_extract_all(content, '\\bHACK\\b')) as hack
    from o_code_lang where not ignored) where todo + fixme + hack > 0"""


@query("debt_markers", _DEBT)
def _(t: Inputs) -> DataFrame:
    return quality.debt_markers(t.code_files)


@query(
    "debt_rollup",
    f"""select repo_id, language, count(*) as files, sum(todo)::bigint as todo, sum(fixme)::bigint as fixme, sum(hack)::bigint as hack,
               grouping(repo_id, language) as level from ({_DEBT}) group by rollup (repo_id, language)""",
)
def _(t: Inputs) -> DataFrame:
    return quality.debt_rollup(t.code_files)


@query(
    "health_trend",
    """with p as (select repo_id, date_trunc('month', ts) as period, count(*) as changes, sum(lines_added + lines_deleted)::bigint as churn from sparse_changes group by all),
       months as (select repo_id, unnest(generate_series(min(period)::timestamp, max(period)::timestamp, interval 1 month)) as period from p group by repo_id),
       d as (select repo_id, m.period, coalesce(changes, 0) as changes, coalesce(churn, 0) as churn from months m left join p using (repo_id, period))
       select repo_id, strftime(period, '%Y-%m-%d %H:%M:%S') as period, changes, churn, avg(churn) over (w rows 3 preceding) as churn_avg,
              (churn - lag(churn) over w)::double as churn_delta
       from d window w as (partition by repo_id order by period)""",
)
def _(t: Inputs) -> DataFrame:
    return quality.health_trend(t.sparse_changes).withColumn("churn_delta", F.col("churn_delta").cast("double"))


@query(
    "cross_repo_rollup",
    """select repo_id, language, sum(line_count)::bigint as line_count, sum(file_count)::bigint as file_count, grouping(repo_id, language) as level
       from o_langs group by cube (repo_id, language)""",
)
def _(t: Inputs) -> DataFrame:
    return quality.cross_repo_rollup(languages.languages(t.files))


@query(
    "stream_change_counts",
    """select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d %H:%M:%S') as window_end,
              event_type, count(distinct event_id) as change_count from events group by all""",
)
def _(t: Inputs) -> DataFrame:
    """The events table read as a stream of deliveries; users stand for authors, event types for files."""
    # As a pattern the path may name one file as well as a folder of files.
    stream = change_counts.read_stream(
        t.spark, f"{t.folder}/events.parque[t]", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    )
    keys = ["event_type"]
    return change_counts.run_once(change_counts.stream_change_counts(stream, keys, "event_id"), keys)
