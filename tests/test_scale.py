"""Steps whose cost must follow the input: one reading of texts, one shuffle of rows, work on every task."""

import glob
import os
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoquarry.operators import dependencies, postings, renames, secrets, stored_index
from repoquarry.operators.skew import paged_lists
from repoquarry.session import stored
from repoquarry.streaming import change_counts
from repoquarry.workload.views import Inputs


def one_split(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_blocks_of_index(spark, tmp_path, limit):
    rows = [("r", f"p{i:03}", "word " * (i % 4 + 1) + f"only{i} x") for i in range(40)] + [("s", "q", "x word"), ("s", "null", None), (None, "lost", "word")]
    place = str(tmp_path / "index")
    stored_index.store_index(one_split(spark, rows, "repo_id string, path string, content string"), place, block=8, rows_per_group=limit)
    found = spark.read.parquet(f"{place}/postings").filter("term = 'word'").orderBy("repo_id", "block").collect()
    assert [(r.repo_id, r.block, r.docs, r.max_tf) for r in found] == [("r", 0, 8, 4), ("r", 1, 8, 4), ("r", 2, 8, 3), ("r", 3, 8, 2), ("r", 4, 8, 1), ("s", 0, 1, 1)]
    order = sorted(range(40), key=lambda i: (-(i % 4 + 1), i))
    assert [p for r in found[:5] for p in r.paths] == [f"p{i:03}" for i in order]
    assert [len(p) for r in found[:5] for p in r.positions] == [tf for r in found[:5] for tf in r.tfs] == [i % 4 + 1 for i in order]
    assert found[5].positions == [[1]]


def test_packing_goes_on_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [("r", f"p{i:03}", "a b" if i % 2 else "b") for i in range(30)]
        stored_index.store_index(one_split(spark, rows, "repo_id string, path string, content string"), str(tmp_path / "i"), block=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(r.term, r.block): r.docs for r in spark.read.parquet(str(tmp_path / "i/postings")).collect()}
    assert found == {("a", b): 4 if b < 3 else 3 for b in range(4)} | {("b", b): 4 if b < 7 else 2 for b in range(8)}


def test_index_takes_little_disk(spark, tmp_path):
    """Shuffles and index together, against the texts as Parquet."""
    draw = random.Random(5)
    words = [f"{draw.choice('bcdfgl')}{draw.choice('aeiou')}{i}" for i in range(4000)]
    rows = [("r", f"src/{i % 7}/f{i}_main.py", " ".join(words[min(3999, int(draw.paretovariate(0.6)))] for _ in range(300))) for i in range(6000)]
    texts = stored(one_split(spark, rows, "repo_id string, path string, content string"), str(tmp_path / "texts"))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    size = lambda folder: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))
    before = files()
    stored_index.store_index(texts, str(tmp_path / "index"))
    shuffled = sum(os.path.getsize(f) for f in files() - before if os.path.exists(f))
    assert shuffled + size(tmp_path / "index") < 3 * size(tmp_path / "texts")


def test_hash_is_sparks(spark):
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(i)) for i in range(70)] + ["é" * 9, "日本", "ß"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert {r.t: r.h for r in found} == dict(zip(texts, postings.xxhash64(pa.array(texts)).view("int64").tolist()))


@pytest.mark.parametrize("tasks", [3, 70])
def test_slices_join_to_the_same_blocks(spark, tmp_path, monkeypatch, tasks):
    """Terms in slices and in one; pieces of few words; repeated and missing paths, repositories with numbers."""
    draw = random.Random(8)
    docs = [(draw.choice([1, 1, 1, 2, None]), draw.choice([None, f"p{i}", f"p{i}", f"é{i % 9}"]), " ".join(draw.choices("a a a b b c dd ee".split(), k=draw.randrange(9)))) for i in range(150)]
    docs += [(3, "none", ""), (3, "null", None)]
    frame = spark.createDataFrame(docs, "repo_id int, path string, content string").repartition(4)
    monkeypatch.setattr(stored_index, "_WORDS", 40)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        found = []
        for limit in (1_000_000, 20):
            stored_index.store_index(frame, str(tmp_path / f"{limit}"), 8, limit)
            assert not glob.glob(str(tmp_path / f"{limit}/postings/bucket=-1")) and not glob.glob(str(tmp_path / f"{limit}/texts"))
            # Documents of one path and frequency have no order.
            found.append([(r.repo_id, r.term, r.block, r.docs, r.max_tf, r.paths, r.tfs) for r in spark.read.parquet(str(tmp_path / f"{limit}/postings")).orderBy("repo_id", "term", "block").collect()])
            held = sorted((r.repo_id, str(p), r.term, at) for r in spark.read.parquet(str(tmp_path / f"{limit}/postings")).collect() for p, ats in zip(r.paths, r.positions) for at in ats)
            assert held == sorted((k, str(p), w, i) for k, p, text in docs if k is not None for i, w in enumerate((text or "").split()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] and len({r[2] for r in found[0]}) > 5


@pytest.mark.parametrize("limit", [1_000_000, 4])
def test_pages_of_large_and_small_groups(spark, limit):
    rows = [("a", i % 7, i) for i in range(7)] + [("b", 1, 1), ("b", 1, 1), (None, 3, 1), (None, 2, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    paged = paged_lists(df, ["k"], ["o", "v"], F.struct("v", "o"), 2, "listed", rows_per_group=limit)
    found = {(r.k, r.page): (r.pages, [tuple(v) for v in r.listed]) for r in paged.collect()}
    assert found == {
        ("a", 0): (4, [(0, 0), (1, 1)]), ("a", 1): (4, [(2, 2), (3, 3)]), ("a", 2): (4, [(4, 4), (5, 5)]), ("a", 3): (4, [(6, 6)]),
        ("b", 0): (1, [(1, 1), (1, 1)]), (None, 0): (1, [(1, 1), (1, 2), (1, 3)]),
    }


def test_pages_shuffle_rows_once(spark):
    df = spark.range(100).selectExpr("id % 9 as k", "id as o")
    paged = paged_lists(df, ["k"], ["o"], F.col("o"), 3, "listed")
    assert paged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_expensive_texts_reach_every_task(spark):
    files = one_split(spark, [("r", f"d/m{i}.py", f"import a{i}") for i in range(40)], "repo_id string, path string, content string")
    assert dependencies.import_edges(files).rdd.getNumPartitions() > 1
    numbers = files.select("repo_id", "path", F.lit("card 4111111111111111 or 4111111111111112, 0000000000000000").alias("content"))
    found = secrets.secret_tokens(numbers)
    assert found.rdd.getNumPartitions() > 1
    assert found.count() == 40 and found.distinct().count() == 40


def test_files_need_no_join(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    assert "Join" not in t.files._jdf.queryExecution().optimizedPlan().toString()
    assert t.files.select("repo_id", "path", "blob").exceptAll(t.documents.join(t.paths, F.col("i") == F.col("doc_id")).select("lang", "path", F.md5("text"))).isEmpty()


def test_keys_share_states(spark, tmp_path):
    """More keys than states; missing and large keys stay what they are, and each goes idle by itself."""
    schema, big = "k long, s string, id long, ts timestamp", 2**62 + 1
    at = lambda day, h=0: datetime(2024, 1, day, h)
    first = [(big, "x", 1, at(1)), (big, "x", 10, at(1)), (None, "x", 3, at(1, 1)), (None, None, 4, at(2))] + [(i, "y", 100 + i, at(3)) for i in range(20)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([(None, None, 7, at(25)), (0, "y", 8, at(24))], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = change_counts.read_stream(spark, str(tmp_path / "in/*"), schema, maxFilesPerTrigger="1")
    rows = change_counts.newest_changes(stream, ["k", "s"], "id", change="id", idle_days=10, buckets=3)
    change_counts.run_newest(rows, ["k", "s"], str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    table = change_counts.UpsertTable(spark, str(tmp_path / "table"), ["k", "s"], change_counts.by_hash(["k", "s"]))
    found = {(r.k, r.s): (r.change_count, r.last_change, r.idle) for r in table.read().collect()}
    assert found[(big, "x")] == (2, "10", True) and found[(None, "x")] == (1, "3", True) and found[(7, "y")] == (1, "107", True)
    assert found[(0, "y")][:2] == (2, "8") and not found[(0, "y")][2]
    assert len(found) == 23


@pytest.mark.parametrize("rows_in_walk", [100_000, 0])
def test_copies_are_matched_in_few_rounds(spark, monkeypatch, rows_in_walk):
    """Copies of near texts, one tie between texts that is not all with all, names that both sides have: rounds do not follow the number of copies."""
    stored = []
    monkeypatch.setattr(renames, "cut_lineage", lambda df, cut=renames.cut_lineage: stored.append(df) or cut(df))
    body = "\n".join(f"line {i}" for i in range(20))
    gone = [("r", f"a/{i % 7}/f{i}", body + f"\nend {i % 2}") for i in range(40)] + [("r", f"a/{i}/same", body) for i in range(3)] + [("s", "a/x", body)] * 2
    new = [("r", f"b/{i % 5}/g{i}", body + f"\nfin {i % 2}") for i in range(30)] + [("r", f"b/{i}/same", body + "\nnew 1") for i in range(2)] + [("s", "b/x", body + "\n")]
    gone += [("t", f"a/{i}", f"{body}\n{'one' if i % 2 else 'two'}\nold") for i in range(6)]
    new += [("t", f"b/{i}", f"{body}\n{('one', 'two', 'six')[i % 3]}\nnew") for i in range(6)]
    make = lambda rows: spark.createDataFrame(rows, "repo_id string, path string, content string")
    pairs, files = renames.similar_texts(make(gone), make(new), 0.5)
    assert pairs.filter("repo_id = 'r'").count() == 9
    found = {(r.repo_id, r.new): (r.old, round(r.similarity, 6)) for r in renames.match_texts(pairs, files, rows_in_walk=rows_in_walk).collect()}
    assert len(stored) < 60
    every = []
    for repo in ("r", "t"):
        weights = lambda text: {line: len(line) + 1 for line in text.split("\n")}
        for _, p, a in (g for g in gone if g[0] == repo):
            for _, q, b in (n for n in new if n[0] == repo):
                common = sum(w for line, w in weights(a).items() if line in weights(b))
                every.append((-common / max(len(a) + 1, len(b) + 1), p.split("/")[-1] != q.split("/")[-1], p, q, repo))
    expected, used = {}, set()
    for far, _, p, q, repo in sorted(every):
        if (repo, p) not in used and (repo, q) not in used:
            used |= {(repo, p), (repo, q)}
            expected[repo, q] = (p, round(-far, 6))
    assert {k: v for k, v in found.items() if k[0] != "s"} == expected
    assert found["s", "b/x"][0] == "a/x"
