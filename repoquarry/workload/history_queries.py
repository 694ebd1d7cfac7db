"""Commit logs, changes and snapshots."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import history, snapshots
from repoquarry.plans import profile, reports
from repoquarry.sources import tables
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"


@query("scan_commits", f"select repo_id, commit_id, author, {_TS}, message from commits")
def _(t: Inputs) -> DataFrame:
    return tables.scan_commits(t.commits)


@query("scan_changes", f"select repo_id, commit_id, file_path, change_type, old_path, lines_added, lines_deleted, {_TS} from file_changes")
def _(t: Inputs) -> DataFrame:
    return tables.scan_changes(t.file_changes)


@query("commit_totals", "select repo_id, count(*) as total_commits from commits group by all")
def _(t: Inputs) -> DataFrame:
    return history.commit_totals(t.commits)


@query("recent_authors", "select repo_id, array_to_string(authors, '|') as authors, len(authors) as authors_count from o_recent_authors")
def _(t: Inputs) -> DataFrame:
    return history.recent_authors(t.commits).withColumn("authors", F.array_join("authors", "|"))


@query("distinct_authors", "select repo_id, count(distinct author) as authors from commits group by all")
def _(t: Inputs) -> DataFrame:
    return t.commits.select("repo_id", "author").distinct().groupBy("repo_id").agg(F.count("author").alias("authors"))


@query(
    "latest_commit",
    "select repo_id, commit_id as last_commit, strftime(ts, '%Y-%m-%d %H:%M:%S') as last_commit_date from o_log where pos = 1",
)
def _(t: Inputs) -> DataFrame:
    return history.latest_commit(t.commits)


@query(
    "recent_commits",
    f"""select repo_id, commit_id, author, {_TS}, message, pos as rank from o_log
        where pos <= 10 and ts >= (select max(ts) from commits) - interval 1 day""",
)
def _(t: Inputs) -> DataFrame:
    """The newest ten of each repository, as far as they fall on the last two days of all."""
    last = t.commits.agg(F.max("ts")).first()[0]
    return history.recent_commits(t.commits, 10, last - timedelta(days=1))


@query(
    "change_frequency",
    """select repo_id, file_path, count(*) as change_count from file_changes
       join (select repo_id, commit_id from o_log where pos <= 200) using (repo_id, commit_id)
       group by all having count(*) >= 2""",
)
def _(t: Inputs) -> DataFrame:
    return history.change_frequency(t.commits, t.file_changes, 200, 2)


@query(
    "commit_rollup",
    """select c.repo_id, c.commit_id, c.author, count(f.commit_id) as file_count,
              cast(coalesce(sum(lines_added), 0) as bigint) as total_additions, cast(coalesce(sum(lines_deleted), 0) as bigint) as total_deletions
       from commits c left join file_changes f using (repo_id, commit_id) group by all""",
)
def _(t: Inputs) -> DataFrame:
    return history.commit_rollup(t.commits, t.file_changes).drop("ts", "message")


@query(
    "commit_files",
    """select repo_id, commit_id, (ordinal - 1) // 3 as page, max((n + 2) // 3) as pages, count(*) as files, string_agg(change, '|' order by ordinal) as listed
       from (select *, count(*) over (partition by repo_id, commit_id) as n, concat_ws(':', file_path, change_type, old_path, lines_added, lines_deleted) as change,
                    row_number() over (partition by repo_id, commit_id order by file_path, change_type, old_path nulls first, lines_added, lines_deleted) as ordinal
             from file_changes) group by all""",
)
def _(t: Inputs) -> DataFrame:
    nested = history.commit_files(t.file_changes, page_size=3)
    fields = ["file_path", "change_type", "old_path", "lines_added", "lines_deleted"]
    listed = F.transform("files_changed", lambda c: F.concat_ws(":", *[c[f].cast("string") for f in fields]))
    return nested.select(
        "repo_id", "commit_id", "page", "pages", F.size("files_changed").alias("files"),
        F.array_join(listed, "|").alias("listed"),
    )


@query(
    "file_history",
    f"""select repo_id, file_path, commit_id, author, {_TS}, message, rank from (
          select *, row_number() over (partition by repo_id, file_path order by ts desc, commit_id desc) as rank
          from (select distinct f.repo_id, f.file_path, f.commit_id, c.author, c.ts, c.message
                from file_changes f join commits c using (repo_id, commit_id))) where rank <= 50""",
)
def _(t: Inputs) -> DataFrame:
    return history.file_history(t.commits, t.file_changes)


@query(
    "commit_digest",
    """select repo_id, rank, commit_id, file_count, total_additions, total_deletions,
         chr(10) || rank || '. ' || left(cast(commit_id as varchar), 8) || ' by ' || author || chr(10) || '   📅 ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
         || chr(10) || '   💬 ' || left(string_split(message, chr(10))[1], 80)
         || case when file_count > 0 then chr(10) || '   📄 ' || file_count || ' file' || case when file_count = 1 then '' else 's' end || ' changed'
              || case when total_additions > 0 or total_deletions > 0
                      then chr(10) || '   ➕' || total_additions || ' ➖' || total_deletions || ' lines' else '' end else '' end as text
       from (select l.repo_id, l.pos as rank, l.commit_id, l.author, l.ts, l.message, count(f.commit_id) as file_count,
                    cast(coalesce(sum(lines_added), 0) as bigint) as total_additions, cast(coalesce(sum(lines_deleted), 0) as bigint) as total_deletions
             from o_log l left join file_changes f using (repo_id, commit_id) where l.pos <= 5 group by all)""",
)
def _(t: Inputs) -> DataFrame:
    return reports.commit_digest(t.commits, t.file_changes)


@query(
    "diff_snapshots",
    """with recursive f as (select coalesce(a.repo_id, b.repo_id) as repo_id, coalesce(a.path, b.path) as path, a.blob as ba, b.blob as bb,
                         a.path is not null as ia, b.path is not null as ib, a.content as ca, b.content as cb
                  from snapshot_a a full join snapshot_b b on a.repo_id = b.repo_id and a.path = b.path),
       d as (select repo_id, path, ba as blob, ca as content, row_number() over (partition by repo_id, ba order by md5(path), path) as n from f where not ib),
       n as (select repo_id, path, bb as blob, cb as content, row_number() over (partition by repo_id, bb order by md5(path), path) as n from f where not ia),
       p as (select d.repo_id as dr, d.path as old, d.content as oc, n.repo_id as nr, n.path as new, n.content as nc
             from d full join n on d.repo_id = n.repo_id and d.blob = n.blob and d.n = n.n),
       lg as (select repo_id, old, line, sum(length(line) + 1) as w from (select dr as repo_id, old, unnest(string_split(oc, chr(10))) as line from p where new is null) group by all),
       ln as (select repo_id, new, line, sum(length(line) + 1) as w from (select nr as repo_id, new, unnest(string_split(nc, chr(10))) as line from p where old is null) group by all),
       s as (select lg.repo_id, old, new, sum(least(lg.w, ln.w)) as common from lg join ln using (repo_id, line) group by all),
       e as (select s.repo_id, s.old, s.new, common::double / greatest(length(x.oc) + 1, length(y.nc) + 1) as similarity
             from s join p x on x.dr = s.repo_id and x.old = s.old and x.new is null join p y on y.nr = s.repo_id and y.new = s.new and y.old is null),
       o as (select *, row_number() over (order by similarity desc, regexp_extract(old, '[^/]*$') <> regexp_extract(new, '[^/]*$'), old, new, repo_id) as r from e where similarity >= 0.5),
       walk as (select 0::bigint as r, []::varchar[] as used, []::bigint[] as taken
                union all
                select o.r, case when free then used || ['a ' || repo_id || ' ' || old, 'b ' || repo_id || ' ' || new] else used end, case when free then taken || [o.r] else taken end
                from (select o.*, used, taken, not list_contains(used, 'a ' || repo_id || ' ' || old) and not list_contains(used, 'b ' || repo_id || ' ' || new) as free
                      from walk join o on o.r = walk.r + 1) o),
       m as (select o.* from o where r in (select unnest(taken) from walk where walk.r = (select max(r) from walk)))
       select repo_id, path as file_path, 'M' as change_type, cast(null as varchar) as old_path, cast(null as double) as similarity from f where ia and ib and ba <> bb
       union all
       select nr, new, 'R', old, 1.0 from p where old is not null and new is not null
       union all
       select repo_id, new, 'R', old, similarity from m
       union all
       select dr, old, 'D', null, null from p where new is null and not exists (select 1 from m where m.repo_id = dr and m.old = p.old)
       union all
       select nr, new, 'A', null, null from p where old is null and not exists (select 1 from m where m.repo_id = nr and m.new = p.new)""",
)
def _(t: Inputs) -> DataFrame:
    return snapshots.diff_snapshots(t.snapshot_a, t.snapshot_b)


@query(
    "incremental_profile",
    """select b.repo_id, b.path, b.blob, e.language, length(text) - length(replace(text, chr(10), ''))
              + case when text <> '' and right(text, 1) <> chr(10) then 1 else 0 end as line_count
       from (select s.repo_id, s.path, s.blob, case when f.size % 7 = 0 then concat(f.content, '!') else f.content end as text
             from snapshot_b s join files f on f.repo_id = s.repo_id and f.path = replace(s.path, 'moved/', '')) b
       left join o_ext e on e.ext = lower(regexp_extract(b.path, '([.][^./]+)$', 1))""",
)
def _(t: Inputs) -> DataFrame:
    """Snapshot b profiled from the stored facts of snapshot a."""
    files = t.files
    kept = files.filter("(size + length(path)) % 10 <> 0")
    later = files.filter("(size + length(path)) % 10 <> 1").selectExpr(
        "repo_id",
        "case when size % 5 = 2 then concat('moved/', path) else path end as path",
        "case when size % 7 = 0 then concat(content, '!') else content end as content",
    ).withColumn("blob", F.md5("content"))
    later = later.withColumn("size", F.length("content"))
    stats = snapshots.incremental_stats(snapshots.file_stats(kept), later)
    return stats.select("repo_id", "path", "blob", "language", "line_count")


@query(
    "incremental_repo_profile",
    """with n as (select repo_id, path, coalesce(language, '') as language,
                  length(text) - length(replace(text, chr(10), '')) + case when text <> '' and right(text, 1) <> chr(10) then 1 else 0 end as lines
           from (select b.repo_id, b.path, e.language, case when f.size % 7 = 0 then concat(f.content, '!') else f.content end as text
                 from snapshot_b b join files f on f.repo_id = b.repo_id and f.path = replace(b.path, 'moved/', '')
                 left join o_ext e on e.ext = lower(regexp_extract(b.path, '([.][^./]+)$', 1))
                 where len(list_filter(string_split(b.path, '/'), lambda x: x like '.%')) = 0)),
       l as (select repo_id, language, sum(lines) as s from n where language <> '' group by all)
       select repo_id, count(*) as total_files,
              (select arg_min(language, (-s, language)) from l where l.repo_id = n.repo_id) as primary_language
       from n group by repo_id""",
)
def _(t: Inputs) -> DataFrame:
    """The profile of snapshot b, from the stored facts of snapshot a and the contents of what changed."""
    files = t.files
    kept = files.filter("(size + length(path)) % 10 <> 0")
    later = files.filter("(size + length(path)) % 10 <> 1").selectExpr(
        "repo_id",
        "case when size % 5 = 2 then concat('moved/', path) else path end as path",
        "case when size % 7 = 0 then concat(content, '!') else content end as content",
    ).withColumns({"blob": F.md5("content"), "size": F.length("content")})
    stats = snapshots.incremental_stats(snapshots.file_stats(kept), later)
    return profile.repo_profile(stats, t.commits).select("repo_id", "total_files", "primary_language")
