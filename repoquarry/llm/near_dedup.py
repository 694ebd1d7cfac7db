"""Near-duplicate documents: ProbMinHash signatures of the sets of word shingles, banding, exact verification, classes.

Rows with the same set of shingles are one node. Nodes that agree in a band share a bucket. Every bucket names a leader, its members
propose to it, proposals with similar signatures are verified on the shingle sets, and verified links merge classes; so a large group
of near copies costs a proposal per member, not one per pair. Buckets of one class are done. The nodes of the others, as a
rule texts around a common passage, are joined on their rarest shingles, which loses no pair of them of the wanted similarity and makes
none of what is common to all. Bands, signatures and verification all take a shingle once, however often the text repeats it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.llm.shingles import shingles, signatures
from repoquarry.llm.tables import bucketed, join_groups, map_arrow, scratch, written
from repoquarry.llm.texts import slices

BANDS, ROWS, SIZE = 40, 6, 241
"""Bands of rows; the number of signature places is a prime. A pair of similarity 0.8 misses all bands once in 180,000."""
ESTIMATE = 151
"""Places that estimate a similarity."""
_SLACK = 0.2
"""Proposals to leaders whose signatures agree in less than the threshold less this (six standard deviations) are left to the join."""
_SLICE = 1_500_000
"""Bytes of text sketched at once: a shingle takes some hundred bytes of arrays, a text several thousand."""
_LAST = (1 << 63) - 1
_LED = 1000
"""Proposals to one leader that are verified in one task."""


def sketches(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Per row: `row_id, doc_id, k1, k2` (128-bit hash of the shingle set), `n`, `bands`, `signature` (a byte each), `shingles`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _SLICE):
            found = shingles(batch.column(text), width)
            # What is verified is the similarity of sets, so that is what the places have to estimate.
            full = signatures(found._replace(counts=np.ones_like(found.counts)), SIZE)
            keys, sets = [], []
            for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
                own = found.hashes[a:b]
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sets.append(np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes())
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            bands = np.ascontiguousarray(full[:, : BANDS * ROWS]).reshape(len(full) * BANDS, ROWS)
            hashed = np.zeros(len(bands), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + bands[:, k]
                    hashed ^= hashed >> np.uint64(29)
                hashed += np.tile(np.arange(BANDS, dtype=np.uint64), len(full)) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(doc_id).cast(pa.int64()),
                    pa.array(pairs[:, 0]),
                    pa.array(pairs[:, 1]),
                    pa.array(np.diff(found.offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * BANDS, hashed.view(np.int64)),
                    pa.array([row.tobytes() for row in (full[:, :ESTIMATE] >> np.uint64(40)).astype(np.uint8)], pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                ["doc_id", "k1", "k2", "n", "bands", "signature", "shingles"],
            )

    schema = "doc_id bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>, signature binary, shingles binary"
    rows = map_arrow(docs.select(F.col(doc_id).cast("bigint").alias(doc_id), text), run, schema)
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def merge(labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame | None:
    """Labels `(node, class)` after the links `(a, b)` have joined classes; a node without a label is its own class.

    Labels hook onto their smallest neighbour and are followed to the end, until no link joins two labels. Every step is a
    stored table, so lost executors cost one step.
    """
    while True:
        joined = links.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
        if labels is not None:
            of_a = labels.select(F.col("node").alias("a"), F.col("class").alias("la"))
            of_b = labels.select(F.col("node").alias("b"), F.col("class").alias("lb"))
            joined = joined.join(of_a, "a", "left").join(of_b, "b", "left").select("a", "b", F.coalesce("la", "ca").alias("ca"), F.coalesce("lb", "cb").alias("cb"))
        hooks = joined.filter("ca <> cb").groupBy(F.greatest("ca", "cb").alias("child")).agg(F.min(F.least("ca", "cb")).alias("parent"))
        hooks = written(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            return labels
        while True:
            up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("top"))
            jumped = written(hooks.join(up, "parent", "left").select("child", F.coalesce("top", "parent").alias("parent"), "top"), f"{name}-jump")
            hooks = jumped.select("child", "parent")
            if jumped.filter("top is not null").isEmpty():
                break
        # A class is named after one of its nodes, which moves with it.
        moved = hooks.select(F.col("child").alias("class"), "parent")
        fresh = moved.select(F.col("class").alias("node"), F.col("parent").alias("class"))
        if labels is not None:
            old = labels.join(moved, "class", "left").select("node", F.coalesce("parent", "class").alias("class"))
            fresh = old.unionByName(fresh.join(labels, "node", "left_anti"))
        labels = written(fresh, f"{name}-labels")


def _verified(proposals: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The proposals `(leader, node)` whose shingle sets have a Jaccard similarity of `threshold` or more.

    The set of a leader with many proposals is repeated for every thousand of them, so none is a hot key.
    """
    counts = proposals.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(_LED)).cast("int").alias("parts"))
    parts = counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    led = parts.join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("led")), "leader")
    many = parts.filter("part = 0 and parts > 1").select("leader", "parts")
    own = proposals.join(many, "leader", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    own = own.select("leader", "part", "node").join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("led"), batch.column("shingles"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node")], ["leader", "node"]).filter(pa.array(keep, pa.bool_()))

    met = own.join(led.select("leader", "part", "led"), ["leader", "part"]).select("leader", "node", "led", "shingles")
    return map_arrow(met, compare, "leader bigint, node bigint")


def _alike(proposals: DataFrame, notes: DataFrame, least: float) -> DataFrame:
    """The proposals whose signatures agree in a share of `least` at least."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ESTIMATE) for c in ("sa", "sb"))
            keep = (a == b).mean(1) >= least if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node")], ["leader", "node"]).filter(pa.array(keep, pa.bool_()))

    met = proposals.join(notes.select(F.col("node"), F.col("signature").alias("sb")), "node")
    met = met.join(notes.select(F.col("node").alias("leader"), F.col("signature").alias("sa")), "leader")
    return map_arrow(met.select("leader", "node", "sa", "sb"), compare, "leader bigint, node bigint")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs`: `doc_id, class_id, class_size, n_shingles, row_id`.

    Two texts are linked if their sets of `width` words in a row have a Jaccard similarity of `threshold` or more; classes are what
    links connect. `class_id` is the smallest id of the class. A shingle counts once, however often the text repeats it. A text of fewer words is one
    shingle; texts without words (null, empty, white space) are alone, each a class of its own. Null ids stay null and count as larger
    than all others. Repeated rows are in one class. No rows give no rows. The result is stored; all tables on the way to it are removed.
    """
    with scratch(docs.sparkSession):
        return written(_near_classes(docs, doc_id, text, width, threshold), "near-classes", keep=True)


def _near_classes(docs: DataFrame, doc_id: str, text: str, width: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    rows = written(sketches(docs, doc_id, text, width), "sketches")
    keys = ["k1", "k2"]
    nodes = written(rows.filter("n > 0").groupBy(*keys).agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    one = rows.select(F.col("row_id").alias("node"), "bands", "signature").join(nodes.select("node"), "node", "left_semi")
    banded = written(one, "node-bands")
    entries = banded.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    buckets = written(entries.join(shared, "bucket", "left_semi"), "buckets")
    members = buckets.select("node").distinct()
    # Bucketed by node, so that every verification finds the sets where they are.
    sets = spark.table(bucketed(rows.select(F.col("row_id").alias("node"), "shingles").join(members, "node", "left_semi"), "sets", ["node"]))
    notes = written(banded.select("node", "signature").join(members, "node", "left_semi"), "notes")
    merged = _classes(buckets, sets, notes, threshold)
    own = nodes if merged is None else nodes.join(merged, "node", "left")
    klass = F.col("node") if merged is None else F.coalesce("class", "node")
    labelled = own.select(*keys, "rows", "least", klass.alias("class"))
    sums = labelled.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    groups = written(labelled.select(*keys, "rows", "class").join(sums, "class").select(*keys, "rows", "class", "class_id", "class_size"), "groups")
    told = join_groups(rows.filter("n > 0").select("row_id", "doc_id", "n", *keys), groups, keys, "rows")
    alone = rows.filter("n = 0").select("row_id", "doc_id", "n", F.col("row_id").alias("class"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return told.select(*alone.columns).unionByName(alone).select(F.col("doc_id").alias(doc_id), "class_id", "class_size", F.col("n").alias("n_shingles"), "row_id")


def _as_links(found: DataFrame, name: str) -> DataFrame:
    return written(found.select(F.col("leader").alias("a"), F.col("node").alias("b")), name)


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs `(leader, node)` of nodes in different classes."""
    if labels is None:
        return pairs
    told = pairs
    for side in ("leader", "node"):
        told = told.join(labels.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class")), side, "left")
    return told.filter(F.coalesce("leader_class", "leader") != F.coalesce("node_class", "node")).select("leader", "node")


def _prefix_pairs(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes that can reach the threshold, from `(node, class)`: no pair that does is missing.

    Two sets of this similarity have a shingle in common among the rarest of each, as many as may be missing from the other and one
    more; and behind the first of these in the order of rarity enough must be left. What many texts share is not rare in any of
    them, so a common passage brings no pairs, and what only one class has is left out before pairs are made.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column("shingles")]
            sizes = np.array([len(v) for v in values], np.int64)
            index = pa.array(np.repeat(np.arange(len(values)), sizes))
            flat = np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(index), batch.column("class").take(index), pa.array(np.repeat(sizes, sizes)), pa.array(flat)], ["node", "class", "size", "shingle"]
            )

    rows = written(map_arrow(placed.join(sets, "node").select("node", "class", "shingles"), unfold, "node bigint, class bigint, size bigint, shingle bigint"), "rest-shingles")
    uses = rows.groupBy("shingle").agg(F.count("*").alias("uses"), (F.min("class") < F.max("class")).alias("mixed"))
    rarest = Window.partitionBy("node").orderBy("uses", "shingle")
    ranked = rows.join(uses, "shingle").withColumn("at", F.row_number().over(rarest))
    prefix = written(ranked.filter(F.col("mixed") & (F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)).drop("uses", "mixed"), "rest-prefixes")
    other = prefix.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "class", "size", "at")])
    least = (F.col("size") + F.col("other_size")) * (threshold / (1 + threshold)) - 1e-6
    left = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) + 1
    fits = (F.col("node") < F.col("other_node")) & (F.col("class") != F.col("other_class")) & (left >= least)
    return prefix.join(other, "shingle").filter(fits).select(F.col("node").alias("leader"), F.col("other_node").alias("node")).distinct()


def _classes(buckets: DataFrame, sets: DataFrame, notes: DataFrame, threshold: float) -> DataFrame | None:
    """Labels `(node, class)` of the nodes that verified links connect; none if there are no links."""

    def settle(labels: DataFrame | None, pairs: DataFrame, name: str) -> DataFrame | None:
        # Each node first proposes to one leader; as a rule that settles its other proposals.
        one = pairs.groupBy("node").agg(F.min("leader").alias("leader"))
        labels = merge(labels, _as_links(_verified(one, sets, threshold), f"{name}-links"), name)
        rest = written(_across(pairs.join(one, ["leader", "node"], "left_anti"), labels), f"{name}-rest")
        return labels if rest.isEmpty() else merge(labels, _as_links(_verified(rest, sets, threshold), f"{name}-more-links"), f"{name}-more")

    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("leader"))
    proposals = buckets.join(leaders, "bucket").filter("node <> leader").select("leader", "node").distinct()
    # A linked pair that is left out here leaves its bucket with two classes, so the join below meets it again.
    labels = settle(None, written(_alike(proposals, notes, threshold - _SLACK), "proposals"), "led")
    placed = buckets.withColumn("class", F.col("node")) if labels is None else (
        buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    )
    placed = written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("bucket")
    open_nodes = written(placed.join(mixed, "bucket", "left_semi").select("node", "class").distinct(), "open-nodes")
    if open_nodes.isEmpty():
        return labels
    return settle(labels, written(_prefix_pairs(open_nodes, sets, threshold), "prefix-pairs"), "rest")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """All columns of `docs`, and of each class of near duplicates the row with the smallest id only.

    If that id is repeated, all rows with it stay. Rows without an id come behind all others, each on its own: one of them stays only
    if its class has no id.
    """
    key = "_key"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    # Only rows without an id are stored, so that the numbers they get stay theirs.
    missing = written(docs.filter(F.col(doc_id).isNull()).withColumn(key, F.lit(_LAST) - F.monotonically_increasing_id()), "without-id")
    keyed = docs.filter(F.col(doc_id).isNotNull()).withColumn(key, F.col(doc_id).cast("bigint")).unionByName(missing)
    classes = near_classes(keyed, key, text, width, threshold)
    gone = classes.filter(F.col(key) > F.col("class_id")).select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
