"""Exact dedup by deterministic block naming, with DataFrame functions only.

Normalised texts are cut into blocks of fixed size. Equal blocks get equal names and different blocks different ones; then adjacent
pairs of names get names in the same way, until one name is left for each document. Two documents have the same text exactly if
they have the same last name after the same number of rounds.

A name is a pair of integers: the 64-bit hash of what is named, and its place in the sorted order of the different things that
share this hash. Sorting therefore happens inside a hash value, spread over all tasks, and only things whose hash is shared have
to be looked up by their content; all others are first in their order. So blocks cross the network once, to be compared, and
names never depend on a hash being free of collisions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.functions.rows import unfold
from repoquarry.llm.tables import join_groups, written


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; null is empty."""
    known = F.coalesce(text, F.lit(""))
    plain = F.octet_length(known) == F.char_length(known)
    return F.when(plain, F.lower(known)).otherwise(F.translate(known, string.ascii_uppercase, string.ascii_lowercase))


def _places(things: DataFrame, content: list[str]) -> DataFrame:
    """`(h, content..., place)` of all things beyond the first of their hash; as a rule there are none.

    Distinct things are shuffled once, equal ones merged before. Which hashes are shared is then known from counts alone.
    """
    distinct = things.select("h", *content).distinct()
    shared = distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    order = Window.partitionBy("h").orderBy(*content)
    return distinct.join(shared, "h", "left_semi").withColumn("place", F.row_number().over(order)).filter("place > 1")


def _named(things: DataFrame, content: list[str], places: DataFrame) -> DataFrame:
    """The things with `place` in place of their content."""
    match = [things[c].eqNullSafe(places[c]) for c in ["h", *content]]
    kept = [things[c] for c in things.columns if c not in content]
    return things.join(places, match, "left").select(*kept, F.coalesce(places["place"], F.lit(1)).alias("place"))


def name_texts(docs: DataFrame, text: str, block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """The columns of `docs` but for the normalised text, `row_id` (unique), `rounds`, `h` and `place`.

    Texts are equal exactly if the last three are. `hash_bits` below 64 makes hashes collide, for tests.
    """
    columns = [c for c in docs.columns if c != text]
    cut = 64 - hash_bits
    sized = docs.select(*columns, F.encode(text, "UTF-8").alias("_bytes"))
    last = F.greatest(F.ceil(F.octet_length("_bytes") / F.lit(block_bytes)).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    keyed = sized.select(*columns, F.monotonically_increasing_id().alias("row_id"), (last + 1).alias("_left"), blocks.alias("_blocks"))
    hashed = F.shiftright(F.xxhash64("block"), cut)
    things = unfold(keyed, [*columns, "row_id", "_left"], F.col("_blocks"), "block", "pos").withColumn("h", hashed)
    places = written(_places(unfold(keyed, [], F.col("_blocks"), "block").withColumn("h", hashed), ["block"]), "block-places")
    names = written(_named(things, ["block"], places), "block-names")
    rows = names.filter("pos = 0").select(*columns, "row_id", F.ceil(F.log2("_left")).cast("int").alias("rounds"), F.col("h").alias("_h"), F.col("place").alias("_place"))
    rounds = names.agg(F.max(F.ceil(F.log2("_left")).cast("int"))).first()[0] or 0
    current = names.filter("_left > 1").select("row_id", "pos", "h", "place", "_left")
    ended = []
    for level in range(rounds):
        half = F.col("pos") % 2
        pairs = current.groupBy("row_id", F.shiftright("pos", 1).alias("pos"), ((F.col("_left") + 1) / 2).cast("int").alias("_left")).agg(
            *[F.max(F.when(half == side, F.col(c))).alias(f"{c}{side}") for side in (0, 1) for c in ("h", "place")]
        )
        content = ["h0", "place0", "h1", "place1"]
        things = pairs.withColumn("h", F.shiftright(F.xxhash64(*content), cut))
        things = written(things, f"pairs-{level}")
        places = written(_places(things, content), f"pair-places-{level}")
        current = written(_named(things, content, places), f"pair-names-{level}")
        ended.append(current.filter("_left = 1").select("row_id", "h", "place"))
        current = current.filter("_left > 1")
    if not ended:
        return rows.withColumnsRenamed({"_h": "h", "_place": "place"})
    last_names = ended[0]
    for part in ended[1:]:
        last_names = last_names.unionByName(part)
    return rows.join(last_names, "row_id", "left").select(
        *columns, "row_id", "rounds", F.coalesce("h", "_h").alias("h"), F.coalesce("place", "_place").alias("place")
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. Of equal texts the largest id stays; null ids are
    smaller than all others. If that id is repeated, one of its rows stays. A group may hold a third of all rows: groups with a
    thousandth of the rows or more are at most a thousand and meet their rows without a shuffle.
    """
    normal = ascii_lower(F.col(text))
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), normal.alias("_text"))
    hashed = slim.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), "_text")
    named = written(name_texts(hashed, "_text", block_bytes, hash_bits), "identities")
    keys = ["rounds", "h", "place"]
    best = F.max(F.struct("doc_id", "row_id")).alias("_best")
    groups = written(named.groupBy(*keys).agg(best, F.count("*").alias("group_size")), "groups")
    joined = join_groups(named, groups, keys, "group_size")
    return joined.select(
        F.col("doc_id").alias(doc_id),
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("_best.row_id")).alias("kept"),
        "text_sha256",
    )
