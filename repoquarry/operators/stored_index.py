"""A stored full-text index: positional postings in blocks of falling term frequency, in buckets by term.

    path/postings/bucket=B   (repo_id, term, block, docs, max_tf, paths, tfs, positions)
    path/sizes               (repo_id, documents)

Blocks of a term hold its documents from the highest frequency down, so the heads of a few lists give a bound below which whole blocks
cannot matter: their columns with the documents are not unfolded. Only the buckets of the wanted terms are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.functions.rows import unfold
from repoquarry.operators import postings
from repoquarry.operators.search import terms_of
from repoquarry.operators.skew import first_rows, spread_join
from repoquarry.session import cut_lineage, removed, ship

BLOCK = 128
BUCKETS = 64
_DOCUMENTS = 500
"""Documents whose words are grouped at once."""
_WORDS = 1_000_000
"""Words whose postings are found together, about."""
_ROWS = 20_000
"""Postings of blocks given out at once, about."""
_PART = 16_000_000
"""Bytes of texts whose postings a task merges, about."""
_SAMPLE = 20_000
"""Documents of a large repository that show its large terms."""
_SLICES = -1
"""Bucket of the slices of large terms, while they are not joined."""


def _grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows `(repo_id, path, term, positions)` of the documents of a batch, whose last column lists their words."""
    words = batch.column("words")
    sizes = words.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = words.flatten().dictionary_encode()
    name = owner * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
    order = np.argsort(name, kind="stable")
    begins = np.flatnonzero(np.diff(name[order], prepend=-1))
    first = order[begins]
    positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
    rows = pa.array(owner[first])
    terms = coded.dictionary.take(coded.indices.take(pa.array(first)))
    return pa.RecordBatch.from_arrays([batch.column("repo_id").take(rows), batch.column("path").take(rows), terms, positions], ["repo_id", "path", "term", "positions"])


def _words(docs: DataFrame) -> DataFrame:
    """`(repo_id, path, words)`: Spark splits the texts."""
    return docs.select("repo_id", "path", F.coalesce(terms_of("content"), F.array().cast("array<string>")).alias("words"))


def term_positions(docs: DataFrame) -> DataFrame:
    """`(repo_id, path, term, positions)` of `docs(repo_id, path, content)`; the first word has position 0.

    Spark splits the texts; the words of a batch are grouped as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _DOCUMENTS):
                yield _grouped(batch.slice(start, _DOCUMENTS))

    ship(docs.sparkSession)
    words = _words(docs)
    kept = words.select("repo_id", "path").schema.fields
    return words.mapInArrow(run, T.StructType([*kept, T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _cuts(docs: DataFrame, large: DataFrame, rows_per_group: int) -> dict:
    """Cuts `(tf, path)` of the documents of terms `(repo_id, term)` into slices of about `rows_per_group`, none for smaller terms.

    They come from some documents of each large repository, as they only share out the work: at most one for every `rows_per_group` postings.
    """
    keys, share = ["repo_id", "term"], F.least(F.lit(1.0), _SAMPLE / F.col("documents"))
    some = docs.join(F.broadcast(large), "repo_id").filter(F.pmod(F.xxhash64("path"), F.lit(1_000_000)) < share * 1_000_000)
    step = F.greatest(F.lit(1), F.floor(share * rows_per_group)).alias("step")
    tf = term_positions(some.select("repo_id", "path", "content")).select(*keys, "path", F.size("positions").alias("tf"))
    counted = tf.groupBy(*keys).agg(F.count("*").alias("_rows")).join(F.broadcast(large), "repo_id").select(*keys, "_rows", step)
    hot = F.broadcast(cut_lineage(counted.filter(F.col("_rows") > F.col("step")).select(*keys, "step")))
    numbered = tf.join(hot, keys).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("tf"), "path")) - 1)
    cuts: dict = {}
    for r in numbered.filter((F.col("_at") > 0) & (F.col("_at") % F.col("step") == 0)).orderBy("_at").select(*keys, "tf", "path").collect():
        cuts.setdefault((r.repo_id, r.term), []).append((r.tf, r.path))
    return cuts


def _joined(slices: DataFrame, block: int) -> DataFrame:
    """Blocks of large terms whose slices, one after the other, lie in blocks of their own: each is cut at the ends of the whole term's."""
    keys = ["repo_id", "term"]
    numbered = slices.withColumns({"_slice": F.expr(f"block div {postings.SLICE}"), "_in": F.col("block") % postings.SLICE})
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each slice.
    shifts = numbered.groupBy(*keys, "_slice").agg(F.sum("docs").alias("_docs")).select(*keys, "_slice", F.coalesce(F.sum("_docs").over(before), F.lit(0)).alias("_shift"))
    placed = numbered.join(F.broadcast(shifts), [*keys, "_slice"]).withColumn("_start", F.col("_shift") + F.col("_in") * block)
    ahead = F.least(F.col("docs"), block - F.col("_start") % block).cast("int")
    cut = lambda at, n: F.struct((F.col("_start") + at).alias("start"), *[F.slice(c, at + 1, n).alias(c) for c in ("paths", "tfs", "positions")])
    both = placed.withColumn("_ahead", ahead).select(*keys, F.explode(F.array(cut(F.lit(0), F.col("_ahead")), cut(F.col("_ahead"), F.col("docs").cast("int") - F.col("_ahead")))).alias("_part"))
    found = both.filter(F.size("_part.paths") > 0).withColumn("block", F.expr(f"_part.start div {block}")).withColumn("_stretch", F.expr("block div 1024"))
    dealt = found.repartition(int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_stretch")
    listed = dealt.groupBy(*keys, "_stretch", "block").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    whole = listed.select(*keys, "block", *[F.flatten(f"_parts.{c}").alias(c) for c in ("paths", "tfs", "positions")])
    return whole.select(*keys, "block", F.size("paths").cast("bigint").alias("docs"), F.col("tfs")[0].cast("bigint").alias("max_tf"), "paths", "tfs", "positions")


def _write(blocks: DataFrame, path: str, mode: str) -> None:
    """Blocks in order. Paths of a term lie in runs that share their beginnings, which is how they are written."""
    packed = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#paths.list.element": "false"}
    blocks.sortWithinPartitions("bucket", "term", "repo_id", "block").write.mode(mode).options(**packed).partitionBy("bucket").parquet(f"{path}/postings")


def store_index(docs: DataFrame, path: str, block: int = BLOCK, rows_per_group: int = 1_000_000) -> None:
    """Writes the index of `docs(repo_id, path, content)`. Documents of no repository are left out.

    Texts of few or uneven splits are first dealt to files for all tasks. The postings of some million words are sent as one compressed piece for
    each part of the buckets; a part is of some million words too, so a task merges it in memory and writes its buckets. A term of more
    than `rows_per_group` documents, which only a repository of as many can have, is merged in slices, so a word found everywhere is never one task's.
    """
    spark = docs.sparkSession
    docs.groupBy("repo_id").agg(F.count("*").alias("documents")).write.mode("overwrite").parquet(f"{path}/sizes")
    texts = docs.select("repo_id", "path", "content").filter("repo_id is not null")
    large = spark.read.parquet(f"{path}/sizes").filter(F.col("documents") > rows_per_group)
    cuts = {} if large.isEmpty() else _cuts(texts, large, rows_per_group)

    splits = texts.withColumn("_split", F.spark_partition_id()).groupBy("_split").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("size"), F.count("*").alias("rows"))
    found = splits.collect()
    sizes, tasks = [r["size"] for r in found], int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-sum(sizes) // _PART), 1)
    parts = parts if parts <= BUCKETS else -(-parts // BUCKETS) * BUCKETS
    if len(sizes) < tasks or max(sizes) * tasks > 2 * sum(sizes):
        # Files for all tasks, which take less disk than a shuffle of the texts.
        files = {"compression": "zstd", "maxRecordsPerFile": max(1, sum(r["rows"] for r in found) // (2 * tasks))}
        texts.write.mode("overwrite").options(**files).parquet(f"{path}/texts")
        texts = spark.read.schema(texts.schema).parquet(f"{path}/texts")
    ship(spark)
    pieces = postings.inverted(_words(texts), parts, BUCKETS, cuts, _WORDS)
    blocks = postings.merged(pieces, parts, docs.schema["repo_id"], block, _ROWS)
    bucket = _bucket(F.col("term"))
    _write(blocks.withColumn("bucket", F.when(F.col("block") >= postings.SLICE, F.lit(_SLICES)).otherwise(bucket)), path, "overwrite")
    if cuts:
        slices = spark.read.schema(T.StructType([*blocks.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/postings").filter(F.col("bucket") == _SLICES)
        _write(_joined(slices, block).withColumn("bucket", bucket), path, "append")
        removed(spark, f"{path}/postings/bucket={_SLICES}")
    removed(spark, f"{path}/texts")


def _blocks(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The blocks of the terms, from their buckets only."""
    buckets = reduce(lambda a, b: a | b, [F.col("bucket") == _bucket(F.lit(t)) for t in terms], F.lit(False))
    return spark.read.parquet(f"{path}/postings").filter(buckets & F.col("term").isin(terms)).drop("bucket")


def search_index(spark: SparkSession, path: str, terms: list[str], k: int = 10, heads: int = 2) -> DataFrame:
    """`(repo_id, rank, path, score)`: what `search_docs` finds, from a stored index.

    The first `heads` blocks of every term give scores that k documents of a repository reach at least. A block whose highest frequency,
    with the highest ones of all other terms, stays below that holds no document of the answer and is left out unopened: a document in it
    is below the bound with all its terms, and is so with some of them.
    """
    blocks = _blocks(spark, path, sorted({t.lower() for t in terms}))
    sizes = spark.read.parquet(f"{path}/sizes")
    df = blocks.groupBy("repo_id", "term").agg(F.sum("docs").alias("df"), F.max("max_tf").alias("top_tf")).join(sizes, "repo_id")
    weights = df.select("repo_id", "term", F.log1p(F.col("documents") / F.col("df")).alias("idf"), "top_tf")

    def scores(chosen: DataFrame) -> DataFrame:
        rows = unfold(chosen, ["repo_id", "term"], F.arrays_zip("paths", "tfs"), "posting").select("repo_id", "term", "posting.paths", "posting.tfs")
        met = spread_join(rows, weights.select("repo_id", "term", "idf"), ["repo_id", "term"], "paths")
        return met.groupBy("repo_id", F.col("paths").alias("path")).agg(F.round(F.sum(F.col("tfs") * F.col("idf")), 6).alias("score"))

    best = first_rows(scores(blocks.filter(F.col("block") < heads)), ["repo_id"], [F.desc("score"), F.asc("path")], k)
    reached = best.filter(F.col("rank") == k).select("repo_id", F.col("score").alias("reached"))
    all_terms = Window.partitionBy("repo_id")
    others = weights.withColumn("others", F.sum(F.col("idf") * F.col("top_tf")).over(all_terms) - F.col("idf") * F.col("top_tf"))
    bounds = others.join(reached, "repo_id", "left").select("repo_id", "term", "idf", "others", "reached")
    able = (F.col("max_tf") * F.col("idf") + F.col("others") >= F.col("reached") - 2e-6) | F.col("reached").isNull()
    hopeful = blocks.join(bounds, ["repo_id", "term"]).filter(able).select(*blocks.columns)
    return first_rows(scores(hopeful), ["repo_id"], [F.desc("score"), F.asc("path")], k)


def _less(positions: str, n: int) -> Column:
    return F.transform(positions, lambda p: p - n)


def search_phrase(spark: SparkSession, path: str, phrase: str, k: int = 10) -> DataFrame:
    """`(repo_id, rank, path, occurrences)`: the k documents of each repository that hold the words next to each other most often.

    Every word brings the places where the phrase would begin; a place that all words agree on is an occurrence. Ties go by path.
    """
    words = [r for r in spark.range(1).select(terms_of(F.lit(phrase)).alias("words")).first().words]
    if not words:
        raise ValueError("a phrase needs a word")
    offsets: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        offsets.setdefault(w, []).append(i)
    blocks = _blocks(spark, path, sorted(offsets))
    rows = unfold(blocks, ["repo_id", "term"], F.arrays_zip("paths", "positions"), "posting").select("repo_id", "term", F.col("posting.paths").alias("path"), "posting.positions")
    starts = F.lit(None).cast("array<array<int>>")
    for w, at in offsets.items():
        shifted = F.array(*[_less("positions", i) for i in at])
        starts = F.when(F.col("term") == w, shifted).otherwise(starts)
    every = F.reduce(F.col("starts"), F.lit(None).cast("array<int>"), lambda all_, x: F.when(all_.isNull(), x).otherwise(F.array_intersect(all_, x)))
    # A document has one row for each different word of the phrase.
    held = rows.withColumn("starts", starts).groupBy("repo_id", "path").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    found = held.filter(F.size("starts") == len(words)).select("repo_id", "path", F.size(every).cast("bigint").alias("occurrences"))
    return first_rows(found.filter("occurrences > 0"), ["repo_id"], [F.desc("occurrences"), F.asc("path")], k)
