from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from repoquarry.streaming import change_counts

SCHEMA = "delivery bigint, ts timestamp, file_path string"


def _deliver(spark, folder, data):
    spark.createDataFrame(data, "delivery bigint, t string, file_path string").selectExpr(
        "delivery", "cast(t as timestamp) as ts", "file_path"
    ).coalesce(1).write.mode("append").parquet(folder)


def _counts(spark, folder):
    stream = change_counts.read_stream(spark, folder, SCHEMA)
    return change_counts.stream_change_counts(stream, ["file_path"], "delivery", window="1 day", delay="1 day")


def test_stream_counts_once_and_drops_late(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    _deliver(spark, source, [(1, "2024-01-10 01:00:00", "a"), (2, "2024-01-10 02:00:00", "a"), (2, "2024-01-10 02:00:00", "a"), (3, "2024-01-10 03:00:00", "b")])
    change_counts.run_to_table(_counts(spark, source), table, checkpoint)
    # A repeated delivery, one more change, and one far behind the watermark.
    _deliver(spark, source, [(1, "2024-01-10 01:00:00", "a"), (4, "2024-01-10 04:00:00", "a"), (5, "2024-01-01 00:00:00", "a")])
    change_counts.run_to_table(_counts(spark, source), table, checkpoint)
    got = change_counts.latest_counts(spark, table, ["file_path"]).select(F.date_format("window_start", "dd"), "file_path", "change_count")
    assert rows(got, "file_path") == [("10", "a", 3), ("10", "b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    _deliver(spark, source, [(i, f"2024-02-{1 + i % 3:02d} {i % 24:02d}:00:00", f"f{i % 5}") for i in range(300)])
    streamed = change_counts.run_once(_counts(spark, source), ["file_path"])
    batch = change_counts.stream_change_counts(spark.read.parquet(source), ["file_path"], "delivery")
    order = ["window_start", "file_path"]
    assert rows(streamed, *order) == rows(batch, *order)


def test_stream_without_input_is_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = change_counts.read_stream(spark, str(tmp_path / "in"), "event_id bigint, ts timestamp, kind string")
    counts = change_counts.stream_change_counts(stream, ["kind"], "event_id")
    assert change_counts.run_once(counts, ["kind"]).collect() == []


def test_table_stays_as_large_as_its_rows(spark, tmp_path):
    """A hundred batches over five windows: one row per window and key, and at most the replaced windows of the last batch beside."""
    table = str(tmp_path / "table")
    held = change_counts._table(spark, table, ["file_path"], spark.createDataFrame([], "window_start timestamp, window_end timestamp, file_path string, change_count bigint").schema)
    want = {}
    for batch in range(100):
        data = [(f"2024-03-{1 + (batch + k) % 5:02d} 00:00:00", f"f{k % 3}", batch * 10 + k) for k in range(2)]
        want.update({(day, file): n for day, file, n in data})
        rows_ = spark.createDataFrame(data, "w string, file_path string, change_count bigint").selectExpr("cast(w as timestamp) as window_start", "cast(w as timestamp) + interval 1 day as window_end", "file_path", "change_count")
        held.upsert(rows_, batch)
        if batch in (30, 77):
            held.upsert(rows_, batch)  # tried again after it was complete
    got = change_counts.latest_counts(spark, table, ["file_path"]).selectExpr("date_format(window_start, 'yyyy-MM-dd HH:mm:ss') as w", "file_path", "change_count")
    assert {(r.w, r.file_path): r.change_count for r in got.collect()} == want
    slots = list((tmp_path / "table").glob("generation=*/slot=*"))
    assert len(slots) <= 5 + 2
    assert len(list((tmp_path / "table").glob("generation=*"))) <= 5 + 2


def test_batch_that_failed_half_way_is_written_anew(spark, tmp_path):
    table = str(tmp_path / "table")
    schema = spark.createDataFrame([], "window_start timestamp, window_end timestamp, k string, change_count bigint").schema
    make = lambda data: spark.createDataFrame(data, "d string, k string, change_count bigint").selectExpr("cast(d as timestamp) as window_start", "cast(d as timestamp) + interval 1 day as window_end", "k", "change_count")
    held = change_counts._table(spark, table, ["k"], schema)
    held.upsert(make([("2024-01-01", "a", 1), ("2024-01-01", "b", 2)]), 0)
    second = make([("2024-01-01", "a", 5)])
    held.upsert(second, 1)
    # As if the job had died before it was complete: readers see the batch before, and the retry completes it.
    (tmp_path / "table" / "generation=1" / "_SUCCESS").unlink()
    read = lambda: sorted((r.k, r.change_count) for r in change_counts.latest_counts(spark, table, ["k"]).collect())
    assert read() == [("a", 1), ("b", 2)]
    held.upsert(second, 1)
    assert read() == [("a", 5), ("b", 2)]


def test_newest_changes_keep_state_over_runs(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: change_counts.newest_changes(change_counts.read_stream(spark, source, SCHEMA), ["file_path"], "delivery", change="delivery", idle_days=10)
    read = lambda: {r.file_path: (r.change_count, str(r.last_ts), r.last_change, r.idle) for r in change_counts.UpsertTable(spark, table, ["file_path"], change_counts.by_hash(["file_path"])).read().collect()}
    _deliver(spark, source, [(1, "2024-01-10 01:00:00", "a"), (2, "2024-01-10 02:00:00", "a"), (2, "2024-01-10 02:00:00", "a"), (3, "2024-01-10 03:00:00", "b")])
    change_counts.run_newest(stream(), ["file_path"], table, checkpoint)
    assert read() == {"a": (2, "2024-01-10 02:00:00", "2", False), "b": (1, "2024-01-10 03:00:00", "3", False)}
    # An older change that is not too late counts, but is not the newest; a late one is dropped.
    _deliver(spark, source, [(4, "2024-01-09 23:00:00", "a"), (5, "2024-01-10 05:00:00", "b"), (6, "2023-01-01 00:00:00", "b")])
    change_counts.run_newest(stream(), ["file_path"], table, checkpoint)
    assert read() == {"a": (3, "2024-01-10 02:00:00", "2", False), "b": (2, "2024-01-10 05:00:00", "5", False)}
    # Much later everything else is idle and its state goes; b begins again.
    _deliver(spark, source, [(7, "2024-03-01 00:00:00", "c")])
    change_counts.run_newest(stream(), ["file_path"], table, checkpoint)
    _deliver(spark, source, [(8, "2024-03-01 01:00:00", "b")])
    change_counts.run_newest(stream(), ["file_path"], table, checkpoint)
    assert read() == {"a": (3, "2024-01-10 02:00:00", "2", True), "b": (1, "2024-03-01 01:00:00", "8", False), "c": (1, "2024-03-01 00:00:00", "7", False)}


def test_stale_reports_of_streams_equal_batch(spark, tmp_path):
    from repoquarry.operators import dependencies

    builds = [("r", i % 7, f"f{i % 5}", f"2024-01-{1 + i % 20:02d} 12:00:00") for i in range(60)]
    changes = [("r", f"f{i % 6}", f"2024-01-{1 + i % 25:02d} {i % 24:02d}:30:00") for i in range(80)]
    make_b = lambda d: spark.createDataFrame(d, "repo_id string, report_id int, file_path string, t string").selectExpr("repo_id", "report_id", "file_path", "cast(t as timestamp) as built_at")
    make_c = lambda d: spark.createDataFrame(d, "repo_id string, file_path string, t string").selectExpr("repo_id", "file_path", "cast(t as timestamp) as ts")
    for n, (b, c) in enumerate([(builds[:40], changes[:50]), (builds[40:], changes[50:])]):
        make_b(b).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        make_c(c).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = change_counts.stale_inputs(
        change_counts.read_stream(spark, str(tmp_path / "b"), "repo_id string, report_id int, file_path string, built_at timestamp"),
        change_counts.read_stream(spark, str(tmp_path / "c"), "repo_id string, file_path string, ts timestamp"), "60 days", "60 days",
    )
    kept = change_counts.run_stale(stream, str(tmp_path / "t"), str(tmp_path / "s"))
    batch = change_counts.stale_inputs(make_b(builds), make_c(changes), "60 days")
    order = ["repo_id", "report_id"]
    got = rows(change_counts.reports_to_refresh(kept), *order)
    assert got == rows(change_counts.reports_to_refresh(batch), *order)
    # The last build of each input is what the batch operator looks at, one row per input.
    last = make_b(builds).groupBy("repo_id", "report_id", "file_path").agg(F.max("built_at").alias("built_at"))
    stale = dependencies.docs_to_refresh(last, make_c(changes)).filter("stale_inputs > 0")
    newest = change_counts.stale_inputs(last, make_c(changes), "60 days")
    assert rows(change_counts.reports_to_refresh(newest).select("repo_id", "report_id", "stale_inputs"), *order) == rows(stale.select("repo_id", "report_id", "stale_inputs"), *order)
