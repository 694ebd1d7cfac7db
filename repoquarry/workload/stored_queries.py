"""Stored indexes, totals by differences, trees read back, tokens and lock files, and streams that keep tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import cells, chunks, dependencies, retractions, secrets, snapshots, stored_index
from repoquarry.sources import tree_source
from repoquarry.streaming import change_counts
from repoquarry.workload.extra_queries import SEARCH_TERMS, SEARCH_TWIN, SIMILAR_TWIN
from repoquarry.workload.registry import query
from repoquarry.workload.views import Inputs


@query("search_index", SEARCH_TWIN)
def _(t: Inputs) -> DataFrame:
    """The search of `search_docs` on an index that is stored first."""
    place = change_counts.new_place(t.spark, "search_index")
    stored_index.store_index(t.files, place)
    return stored_index.search_index(t.spark, place, SEARCH_TERMS)


_PHRASES = ["of the", "the the", "de la", "und der die"]


def _phrase_sql(phrase: str) -> str:
    words = phrase.split()
    same = " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
    return f"""select repo_id, '{phrase}' as phrase, path, count(*) as occurrences
               from (select repo_id, path, w, unnest(range(1, len(w) + 1)) as i from words) where {same} group by all"""


@query(
    "search_phrase",
    f"""with words as (select repo_id, path, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from files),
        found as ({" union all ".join(map(_phrase_sql, _PHRASES))})
        select * from (select repo_id, phrase, row_number() over (partition by repo_id, phrase order by occurrences desc, path) as rank, path, occurrences from found) where rank <= 10""",
)
def _(t: Inputs) -> DataFrame:
    place = change_counts.new_place(t.spark, "search_index")
    stored_index.store_index(t.files, place)
    found = [stored_index.search_phrase(t.spark, place, p).withColumn("phrase", F.lit(p)) for p in _PHRASES]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _vectors(t: Inputs) -> tuple[DataFrame, DataFrame]:
    stored = t.embeddings.selectExpr("label as repo_id", "vec_id as chunk_id", "embedding as vector")
    return stored, chunks.centroids(stored).withColumn("query_id", F.lit("centroid"))


@query("top_k_in_cells", SIMILAR_TWIN)
def _(t: Inputs) -> DataFrame:
    """The retrieval of `top_k_similar` from cells around pivots."""
    stored, asked = _vectors(t)
    return cells.top_k_in_cells(asked, *cells.cell_index(stored), 10)[0]


@query(
    "profile_by_differences",
    """with n as (select b.repo_id, e.language, length(b.content) - length(replace(b.content, chr(10), '')) + case when b.content <> '' and right(b.content, 1) <> chr(10) then 1 else 0 end as lines
                  from snapshot_b b left join o_ext e on e.ext = lower(regexp_extract(b.path, '([.][^./]+)$', 1))
                  where len(list_filter(string_split(b.path, '/'), lambda x: x like '.%')) = 0)
       select repo_id, coalesce(language, '') as language, cast(coalesce(sum(lines) filter (where language is not null), 0) as bigint) as line_count, count(*) as files
       from n group by all""",
)
def _(t: Inputs) -> DataFrame:
    """Totals of snapshot b: those of snapshot a less what the changes remove and with what they bring."""
    sized = lambda s: s.withColumn("size", F.length("content"))
    earlier, later = sized(t.snapshot_a), sized(t.snapshot_b)
    stats = snapshots.file_stats(earlier)
    gone, fresh = retractions.changed_stats(stats, snapshots.diff_snapshots(earlier, later), later)
    totals = retractions.retract(retractions.language_totals(stats), gone, fresh)
    return totals.withColumn("language", F.coalesce("language", F.lit("")))


@query(
    "scan_tree",
    """select repo_id, path, strlen(content) as size, md5(content) as content_md5 from o_tree where content is not null
       union all select repo_id, 'odd/__init__' || name, strlen(content), md5(content) from o_all where content is not null and name not like '.%'""",
)
def _(t: Inputs) -> DataFrame:
    """All files written as trees, once more under names that begin with an underscore, and read back by the data source."""
    place = change_counts.new_place(t.spark, "trees")
    odd = t.files.select("repo_id", F.concat(F.lit("odd/__init__"), F.substring_index("path", "/", -1)).alias("path"), "content")
    tree_source.write_trees(t.files.select("repo_id", "path", "content").unionByName(odd), place)
    back = tree_source.read_trees(t.spark, place)
    return back.select("repo_id", "path", "size", F.md5("content").alias("content_md5"))


_LOCKS = [
    ("poetry.lock", "'[[package]]\nname = \"flask\"\nversion = \"2.' || n || '\"\n\n[[package]]\nname = \"jinja2\"\nversion = \"3.1\"\n'", "python", [("flask", "'2.' || n"), ("jinja2", "'3.1'")]),
    ("Pipfile.lock", "'{\"_meta\": {}, \"default\": {\"six\": {\"version\": \"==1.' || n || '\"}}, \"develop\": {\"tox\": {\"hashes\": []}}}'", "python", [("six", "'1.' || n"), ("tox", "null")]),
    ("package-lock.json", "'{\"lockfileVersion\": 3, \"packages\": {\"\": {\"version\": \"9\"}, \"node_modules/a\": {\"version\": \"1.' || n || '\"}, \"node_modules/a/node_modules/@s/b\": {\"version\": \"2\"}}}'", "javascript", [("a", "'1.' || n"), ("@s/b", "'2'")]),
    ("yarn.lock", "'# yarn\n\n\"@s/b@^2\", \"@s/b@^2.1\":\n  version \"2.' || n || '\"\n\nleft-pad@^1:\n  version \"1.3\"\n'", "javascript", [("@s/b", "'2.' || n"), ("left-pad", "'1.3'")]),
    ("Cargo.lock", "'version = 3\n\n[[package]]\nname = \"serde\"\nversion = \"1.' || n || '\"\nsource = \"x\"\n'", "rust", [("serde", "'1.' || n")]),
    ("go.sum", "'example.com/a v1.' || n || ' h1:x=\nexample.com/a v1.' || n || '/go.mod h1:y=\n'", "go", [("example.com/a", "'v1.' || n")]),
    ("Gemfile.lock", "'GEM\n  specs:\n    rake (13.' || n || ')\n      dep (>= 1)\n\nDEPENDENCIES\n  rake\n'", "ruby", [("rake", "'13.' || n")]),
    ("composer.lock", "'{\"packages\": [{\"name\": \"v/p\", \"version\": \"1.' || n || '\"}], \"packages-dev\": []}'", "php", [("v/p", "'1.' || n")]),
]
"""A lock file of each kind with its entries; `n` is a number of the row."""

_LOCK_ROWS = f"select repo_id, 'locks/m' || i || '/' as dir, i % {len(_LOCKS)} as kind, (i % 40)::varchar as n from code_paths"


@query(
    "locked_dependencies",
    " union all ".join(
        f"select repo_id, dir || '{name}' as path, '{ecosystem}' as ecosystem, '{package}' as package, {version} as version from ({_LOCK_ROWS}) where kind = {kind}"
        for kind, (name, _, ecosystem, entries) in enumerate(_LOCKS)
        for package, version in entries
    ),
)
def _(t: Inputs) -> DataFrame:
    """Each part with a lock file of one kind."""
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, text, _, _) in enumerate(_LOCKS):
        test = F.col("i") % len(_LOCKS) == kind
        path = F.when(test, F.concat(F.lit("locks/m"), F.col("i").cast("string"), F.lit(f"/{name}"))).otherwise(path)
        content = F.when(test, F.expr(text)).otherwise(content)
    files = t.code_paths.withColumn("n", (F.col("i") % 40).cast("string")).select("repo_id", path.alias("path"), content.alias("content"))
    return dependencies.locked_dependencies(files)


# A card number of 16 digits: 15 from the row, then the check digit, or one more than it in every other row.
_DIGITS = "concat('400000', lpad(cast(i as varchar(20)), 9, '0'))"
_SUM = " + ".join(
    f"({d}) * {'2' if k % 2 == 0 else '1'} - {'case when (' + d + ') > 4 then 9 else 0 end' if k % 2 == 0 else '0'}"
    for k in range(15)
    for d in [f"cast(substr({_DIGITS}, {k + 1}, 1) as int)"]
)
_CARD = f"concat({_DIGITS}, cast((10 - ({_SUM}) % 10 + i % 2) % 10 as varchar(20)))"
_HEX = "md5(cast(i as varchar(20)))"
_SECRETS = f"concat('row ', cast(i as varchar(20)), chr(10), 'key = ', {_HEX}, chr(10), 'card ', {_CARD}, ' account DE89370400440532013000 and GB00WEST12345698765432', chr(10), 'path aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa')"


@query(
    "secret_tokens",
    f"""with t as (select repo_id, path, i, length('row ' || i) + 1 as head from code_paths),
        f as (select repo_id, path, 'random_hex' as kind, head + 7 as position, {_HEX} as token from t
              where (select entropy(c) from (select unnest(string_split({_HEX}, '')) as c)) >= 3
              union all select repo_id, path, 'card_number', head + 7 + 32 + 1 + 5, {_CARD} from t where i % 2 = 0
              union all select repo_id, path, 'bank_account', head + 7 + 32 + 1 + 5 + 16 + 9, 'DE89370400440532013000' from t)
        select * from f""",
)
def _(t: Inputs) -> DataFrame:
    """Each part with a random key, a card number that is right in every other row, a right and a wrong account number."""
    return secrets.secret_tokens(t.code_paths.select("repo_id", "path", F.expr(_SECRETS).alias("content")))


def _events(t: Inputs) -> DataFrame:
    # As a pattern the path may name one file as well as a folder of files.
    return change_counts.read_stream(t.spark, f"{t.folder}/events.parque[t]", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")


@query(
    "stream_newest_changes",
    """select event_type, user_id, count(distinct event_id) as change_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
              cast(arg_max(event_id, (ts, event_id::varchar)) as varchar) as last_change from events group by all""",
)
def _(t: Inputs) -> DataFrame:
    """The events as a stream; users and types stand for files."""
    keys, place = ["event_type", "user_id"], change_counts.new_place(t.spark, "newest")
    rows = change_counts.newest_changes(_events(t), keys, "event_id", change="event_id", idle_days=60)
    change_counts.run_newest(rows, keys, f"{place}/table", f"{place}/checkpoint")
    table = change_counts.UpsertTable(t.spark, f"{place}/table", keys, change_counts.by_hash(keys))
    return table.read().select(*keys, "change_count", "last_ts", "last_change")


@query(
    "stream_reports_to_refresh",
    """with b as (select user_id % 3 as repo_id, event_id as report_id, user_id as file_path, ts as built_at from events where event_type = 'signup'),
       c as (select user_id % 3 as repo_id, user_id as file_path, ts from events where event_type <> 'signup')
       select repo_id, report_id, 1::bigint as stale_inputs, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_change
       from b join c using (repo_id, file_path) where ts > built_at and ts <= built_at + interval 7 days group by all""",
)
def _(t: Inputs) -> DataFrame:
    """Sign-ups stand for reports built from the user's file, all other events for changes of it; both are streams."""
    shaped = _events(t).withColumns({"repo_id": F.col("user_id") % 3, "file_path": F.col("user_id")})
    builds = shaped.filter("event_type = 'signup'").select("repo_id", F.col("event_id").alias("report_id"), "file_path", F.col("ts").alias("built_at"))
    again = _events(t).withColumns({"repo_id": F.col("user_id") % 3, "file_path": F.col("user_id")})
    changes = again.filter("event_type <> 'signup'").select("repo_id", "file_path", "ts")
    place = change_counts.new_place(t.spark, "stale")
    stale = change_counts.run_stale(change_counts.stale_inputs(builds, changes, "7 days"), f"{place}/table", f"{place}/checkpoint")
    return change_counts.reports_to_refresh(stale)
