"""Changes per file and time window from a stream of deliveries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repoquarry.session import shared_dir, ship
from repoquarry.streaming.upserts import UpsertTable, by_hash, keep_table


def read_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """File stream in parquet with a declared schema."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_change_counts(
    stream: DataFrame, keys: list[str], delivery_id: str, time: str = "ts", window: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """`(window_start, window_end, keys, change_count)`, each delivery counted once.

    Works on streams and tables alike. On a stream, deliveries later than `delay` are dropped and duplicates are
    remembered for that long, so state stays bounded. Counts are made in each task before the shuffle.
    """
    timed = stream.withColumn("_time", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        unique = timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark([delivery_id])
    else:
        unique = timed.dropDuplicates([delivery_id])
    counted = unique.groupBy(F.window("_time", window).alias("w"), *keys).agg(F.count("*").alias("change_count"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "change_count")


_VALUES = ("window_start", "window_end", "change_count")


def _table(spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None) -> UpsertTable:
    """Counts by window; a window is a slot."""
    return UpsertTable(spark, path, ["window_start", "window_end", *keys], F.unix_seconds("window_start"), schema)


def run_to_table(counts: DataFrame, table: str, checkpoint: str) -> None:
    """Processes what is available and keeps one row for each window and key in the table.

    A batch rewrites the windows it has counts of, as a rule the newest ones, so the table is as large as its windows and keys,
    whatever the number of batches. Batches that are tried again leave neither gaps nor doubles, and a stream without input is a table
    without rows.
    """
    keys = [c for c in counts.columns if c not in _VALUES]
    keep_table(counts, _table(counts.sparkSession, table, keys, counts.schema), checkpoint)


def latest_counts(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Newest count of each window and key in a table kept by `run_to_table`."""
    return _table(spark, table, keys).read().select("window_start", "window_end", *keys, "change_count")


def run_once(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a count stream to its end in a new place below the shared folder and returns the table of counts."""
    spark = counts.sparkSession
    base = new_place(spark, "change_counts")
    run_to_table(counts, f"{base}/table", f"{base}/checkpoint")
    return latest_counts(spark, f"{base}/table", keys)


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


_STATE = "keys array<string>, change_counts array<bigint>, last_ats array<bigint>, last_changes array<string>, idle_ats array<bigint>"
_NEVER = -(2**63)
_KEY_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_IDLE_DAY = 86_400_000


def newest_changes(
    stream: DataFrame, keys: list[str], delivery_id: str, time: str = "ts", change: str = "commit_id", delay: str = "1 day", idle_days: int = 30, buckets: int = 1024
) -> DataFrame:
    """`(keys, change_count, last_ts, last_change, idle)`: a row for each key and batch that has changes of it, as of then.

    What is held of a key is its changes, and time and id of the newest one (ties: the largest id). A key without a change for
    `idle_days` after its newest one, by the watermark, gives one more row that says so, and what is held of it goes; a later change of it starts
    from one again. Deliveries later than `delay` are dropped and repeated ones are remembered for that long. Changes come to a task in Arrow
    batches, so a key with very many is never held whole. Keys are many and a state is a call of Python, so the keys of a bucket, by their
    hash, share one; a checkpoint stays with its `buckets`.
    """
    ship(stream.sparkSession)
    types = dict(stream.dtypes)
    kept = ", ".join(f"{k} {types[k]}" for k in keys)
    timed = stream.select(*keys, F.col(time).cast("timestamp").alias("_time"), F.col(change).cast("string").alias("_change"), F.col(delivery_id).alias("_delivery"))
    unique = timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["_delivery"])
    # As text, keys of any type and missing ones stay as they are.
    key_text = F.to_json(F.struct(*keys), _KEY_TEXT).alias("_key")
    at = F.coalesce(F.unix_micros("_time"), F.lit(_NEVER)).alias("_at")
    numbered = unique.select(by_hash(keys, buckets).alias("_bucket"), key_text, "_time", at, F.coalesce("_change", F.lit("")).alias("_change"))

    def follow(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: tuple(values) for key, *values in zip(*state.get, strict=True)} if state.exists else {}
        watermark, changed = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for batch in batches:
                for key, *newest in zip(batch["_key"].tolist(), batch["_at"].tolist(), batch["_change"].tolist(), strict=True):
                    count, *last, _ = held.get(key, (0, _NEVER, "", 0))
                    held[key] = (count + 1, *max(last, newest), 0)
                    changed.add(key)
        for key in changed:
            *values, _ = held[key]
            held[key] = (*values, max(values[1] // 1000 + idle_days * _IDLE_DAY, watermark + 1))
        idle = [key for key, values in held.items() if key not in changed and values[-1] < watermark]
        rows = [(key, *held[key][:3], False) for key in changed] + [(key, *held.pop(key)[:3], True) for key in idle]
        if held:
            state.update(tuple(map(list, zip(*[(key, *values) for key, values in held.items()], strict=True))))
            state.setTimeoutTimestamp(min(values[-1] for values in held.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "change_count", "last_at", "last_change", "idle"])

    result = "key string, change_count bigint, last_at bigint, last_change string, idle boolean"
    rows = numbered.groupBy("_bucket").applyInPandasWithState(follow, result, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    last_ts = F.when(F.col("last_at") != _NEVER, F.timestamp_micros("last_at")).alias("last_ts")
    named = rows.select(F.from_json("key", kept, _KEY_TEXT).alias("key"), "change_count", last_ts, "last_change", "idle")
    return named.select("key.*", "change_count", "last_ts", "last_change", "idle")


def run_newest(changes: DataFrame, keys: list[str], table: str, checkpoint: str) -> None:
    """Processes what is available of `newest_changes` and keeps one row for each key in the table."""
    held = UpsertTable(changes.sparkSession, table, keys, by_hash(keys), changes.schema)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        # In one batch a key may both go idle and come again; the later row holds.
        one = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct("last_ts", "idle")).alias("_row")).select("_row.*")
        return old.join(one, keys, "left_anti").select(*new.columns).unionByName(one)

    keep_table(changes, held, checkpoint, merge, "append")


def stale_inputs(builds: DataFrame, changes: DataFrame, within: str = "30 days", delay: str = "1 day") -> DataFrame:
    """`(repo_id, report_id, file_path, built_at, ts)`: changes of a report's input files after it was built and no later than `within`.

    `builds(repo_id, report_id, file_path, built_at)`, `changes(repo_id, file_path, ts)`; streams and tables alike. On streams both
    sides carry a watermark, so a build is kept for `within` and the delays, a change for the delays only.
    """
    built = builds.select("repo_id", "report_id", "file_path", F.col("built_at").cast("timestamp").alias("built_at"))
    changed = changes.select(F.col("repo_id").alias("_repo"), F.col("file_path").alias("_path"), F.col("ts").cast("timestamp").alias("ts"))
    if builds.isStreaming:
        built, changed = built.withWatermark("built_at", delay), changed.withWatermark("ts", delay)
    same = (F.col("repo_id") == F.col("_repo")) & (F.col("file_path") == F.col("_path"))
    after = (F.col("ts") > F.col("built_at")) & (F.col("ts") <= F.col("built_at") + F.expr(f"interval {within}"))
    return built.join(changed, same & after).select("repo_id", "report_id", "file_path", "built_at", "ts")


def run_stale(inputs: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs the joined streams to their end; one row for each stale input of a report, with its newest change."""
    keys = ["repo_id", "report_id", "file_path", "built_at"]
    held = UpsertTable(inputs.sparkSession, table, keys, by_hash(keys), inputs.schema)
    keep_table(inputs, held, checkpoint, lambda old, new: old.unionByName(new).groupBy(*keys).agg(F.max("ts").alias("ts")), "append")
    return held.read()


def reports_to_refresh(stale: DataFrame) -> DataFrame:
    """`(repo_id, report_id, stale_inputs, last_change)` of the reports with stale inputs."""
    newest = stale.groupBy("repo_id", "report_id", "file_path").agg(F.max("ts").alias("ts"))
    return newest.groupBy("repo_id", "report_id").agg(F.count("*").alias("stale_inputs"), F.max("ts").alias("last_change"))
