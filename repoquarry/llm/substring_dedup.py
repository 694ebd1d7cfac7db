"""Substring dedup: words covered by a run of words that also starts in an earlier document go.

Comparing every document with the automata of all others would read the corpus once for every shard of it. So windows first find
the documents they can share: each window of `window` words takes the smallest hash of its `GRAM`-grams as its anchor, and
consecutive windows with the same anchor are a segment. Equal windows have equal anchors, so only segments of one anchor meet. An anchor
found in one document is done, and one whose segments are all equal is decided by their smallest document. Only the different
segments of a shared anchor, at the borders of passages, have their words compared: they are dealt by anchor into reference shards of
bounded size, each shard gets a suffix automaton, and the segments' matching statistics against it name the first document of every
window. An anchor with more different segments than a shard takes has its windows compared by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.llm.suffix_automaton import SuffixAutomaton
from repoquarry.llm.tables import bucketed, map_arrow, scratch, ship, written
from repoquarry.llm.texts import SPACES, buffers, filled, mix, runs, slices, words

GRAM = 5
_LAST = (1 << 63) - 1
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SLICE_BYTES = 6_000_000
SHARD_SEGMENTS = 5_000
"""Different segments in a reference shard; an anchor with more has a table of hashes instead."""


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = words(filled(texts))
    return np.array([xxhash.xxh3_64_intdigest(t) for t in found.table.to_pylist()] or [0], np.uint64)[found.codes], found.offsets


def _rolled(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of the `width` words from each word on; the last `width` - 1 places have no meaning."""
    rolled = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(hashes))):
            rolled[: len(hashes) - k] *= np.uint64(factor)
            rolled[: len(hashes) - k] += hashes[k:]
    return mix(rolled)


def _segment_hash(whole: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hash of all words of a segment: its first and its last window hold them all."""
    with np.errstate(over="ignore"):
        return mix(whole[begin] + mix(whole[begin + windows - 1] + windows.astype(np.uint64)))


def _keyed(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Rows of `id, text` with `h1, h2`: a 128-bit hash of the text where the id is missing or of several rows, else zeros.

    Rows of one id and one text have the same words to lose, so these columns are all that decisions need of a row.
    """
    several = F.col("id") == _LAST
    if repeated is not None:
        docs = docs.join(repeated.withColumn("_several", F.lit(True)), "id", "left")
        several = several | F.col("_several").isNotNull()
    # The seeds differ; one hash made from the other would share its collisions.
    hashes = [F.when(several, F.xxhash64(F.lit(seed), F.col("text"))).otherwise(F.lit(0).cast("bigint")) for seed in (1, 2)]
    return docs.withColumn("h1", hashes[0]).withColumn("h2", hashes[1]).drop("_several")


def _repeated_ids(docs: DataFrame, key: Column) -> DataFrame | None:
    """The ids that several rows have, stored; none if there are none."""
    found = docs.select(key.alias("id")).filter(F.col("id") != _LAST).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    found = written(found, "repeated-ids", keep=True)
    return None if found.isEmpty() else found


def segments(docs: DataFrame, window: int) -> DataFrame:
    """`(anchor, seg, id, starts, hashes, windows, covered)` from `(id, h1, h2, text)`: the places of each different segment of an id.

    `hashes` has `h1, h2` for each of the starts, and is null if the id has one row. `covered` segments also stand in an earlier document of the
    same slice of texts, which decides all their windows; the others are the only ones that travel by anchor, so a passage that a third of all documents share is one row for each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes, offsets = _word_hashes(batch.column("text"))
            n = len(hashes) - window + 1
            if n <= 0:
                continue
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            inside = owner[:n] == owner[window - 1 :]
            grams = _rolled(hashes, GRAM, _FACTORS[0])
            whole = _rolled(hashes, window, _FACTORS[1])
            place = np.arange(n) + sliding_window_view(grams[: n + window - GRAM], window - GRAM + 1).argmin(1)
            place[~inside] = -1
            change = place[1:] != place[:-1]
            begin = np.flatnonzero(inside & np.append(True, change))
            end = np.flatnonzero(inside & np.append(change, True))
            width = end - begin + 1
            anchor = grams[place[begin]]
            seg = _segment_hash(whole, begin, width)
            ids, h1, h2 = (batch.column(c).to_numpy()[owner[begin]] for c in ("id", "h1", "h2"))
            start = begin - offsets[:-1][owner[begin]]
            order = np.lexsort((start, ids, seg, anchor))
            anchor, seg, ids, start, width, h1, h2 = (a[order] for a in (anchor, seg, ids, start, width, h1, h2))
            new_seg = np.append(True, (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])) if len(ids) else np.zeros(0, bool)
            new_row = new_seg | np.append(True, ids[1:] != ids[:-1]) if len(ids) else new_seg
            at = np.flatnonzero(new_row)
            covered = ~new_seg[at]
            # Rows with the id of the first one are told apart by their hashes; an id of one row has none.
            bounds = np.append(at, len(ids))
            several = (h1[at] != 0) | (h2[at] != 0) if len(at) else np.zeros(0, bool)
            taken = np.repeat(several, np.diff(bounds))
            ends = np.concatenate(([0], np.cumsum(np.where(several, 2 * np.diff(bounds), 0)))).astype(np.int32)
            hashed = np.column_stack((h1[taken], h2[taken])).ravel()
            spread = np.where(covered, mix(ids[at].astype(np.uint64) ^ seg[at]), anchor[at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spread.view(np.int64)),
                    pa.array(seg[at].view(np.int64)),
                    pa.array(ids[at]),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), start.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed, pa.int64()), mask=pa.array(~several)),
                    pa.array(width[at].astype(np.int32)),
                    pa.array(covered),
                ],
                ["anchor", "seg", "id", "starts", "hashes", "windows", "covered"],
            )

    return map_arrow(docs, run, "anchor bigint, seg bigint, id bigint, starts array<int>, hashes array<bigint>, windows int, covered boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """`text` compressed, so that moving it to its rows of decisions costs a third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = filled(batch.column("text"))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([pack(t.as_buffer()) for t in texts], pa.binary())], [*rest, "packed"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return map_arrow(docs, run, T.StructType([*kept, T.StructField("packed", T.BinaryType())]))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `text` (binary) for `packed`, in slices of bounded texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sizes = [zstandard.frame_content_size(p.as_buffer()) for p in batch.column("packed")]
        group = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = batch.slice(low, high - low)
            texts = pa.array([unpack(p.as_buffer()) for p in part.column("packed")], pa.binary())
            rest = [n for n in part.schema.names if n != "packed"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), texts], [*rest, "text"])


def _listed(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """Owner of each element of a list column (null: no elements), and the fields of the elements."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    elements = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), [elements.field(n) for n in names]


def _places(starts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of each element of a list column of integers."""
    sizes = pc.list_value_length(starts).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(starts)), sizes), starts.flatten().to_numpy()


def _contents(variants: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The variants with the hashes of their words, `(vid, anchor, id, many, content)`; each is read in its first document.

    Repeated rows repeat the content.
    """
    wanted = variants.groupBy("id", "h1", "h2").agg(F.collect_list(F.struct("vid", "anchor", "seg", "start", "windows", "many")).alias("wanted"))
    met = _packed(docs).join(wanted, ["id", "h1", "h2"]).select("id", "packed", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            hashes, offsets = _word_hashes(batch.column("text"))
            owner, (vid, anchor, seg, start, windows, many) = _listed(batch.column("wanted"), ["vid", "anchor", "seg", "start", "windows", "many"])
            size = windows.to_numpy().astype(np.int64)
            begin = offsets[:-1][owner] + start.to_numpy()
            inside = begin + size + window - 1 <= offsets[1:][owner]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            same = _segment_hash(_rolled(hashes, window, _FACTORS[1]), begin[at], size[at]).view(np.int64) == seg.to_numpy()[at]
            at = at[same]
            lengths = size[at] + window - 1
            ends = np.concatenate(([0], np.cumsum(lengths)))
            index = np.repeat(begin[at] - ends[:-1], lengths) + np.arange(ends[-1])
            take = pa.array(at)
            content = pa.ListArray.from_arrays(ends.astype(np.int32), hashes[index].view(np.int64))
            ids = batch.column("id").take(pa.array(owner[at]))
            yield pa.RecordBatch.from_arrays([vid.take(take), anchor.take(take), ids, many.take(take), content], ["vid", "anchor", "id", "many", "content"])

    return map_arrow(met, run, "vid bigint, anchor bigint, id bigint, many boolean, content array<bigint>")


def _firsts_by_automata(contents: DataFrame, total: int, window: int) -> DataFrame:
    """`(vid, firsts)`: the first document of every window of a variant, by the suffix automaton of its shard."""
    shards = max(1, -(-total // SHARD_SEGMENTS))

    def match(table: pa.Table) -> pa.Table:
        _, order = np.unique(table.column("vid").to_numpy(), return_index=True)
        order = order[np.argsort(table.column("id").to_numpy()[order], kind="stable")]
        vids, ids = (table.column(c).to_numpy()[order].tolist() for c in ("vid", "id"))
        content = table.column("content").to_pylist()
        automaton = SuffixAutomaton()
        for i, at in zip(ids, order.tolist(), strict=True):
            automaton.add(content[at], i)
        return pa.table({"vid": pa.array(vids, pa.int64()), "firsts": pa.array([automaton.firsts(content[at], window)[window - 1 :] for at in order.tolist()], pa.list_(pa.int64()))})

    ship(contents.sparkSession)
    dealt = contents.select("vid", "id", "content", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(match, "vid bigint, firsts array<bigint>")


def _firsts_by_hashes(contents: DataFrame, window: int) -> DataFrame:
    """The same by 128-bit hashes of the windows: for anchors with more different segments than one task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("content")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            n = np.maximum(lengths - window + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(lengths) - lengths)[owner] + place
            both = [_rolled(flat, window, f)[at].view(np.int64) if len(flat) else np.zeros(0, np.int64) for f in _FACTORS[1:]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(owner, pa.int64())) for c in ("vid", "id")), pa.array(place.astype(np.int32)), *map(pa.array, both)],
                ["vid", "id", "place", "w1", "w2"],
            )

    each = written(map_arrow(contents.select("vid", "id", "content"), run, "vid bigint, id bigint, place int, w1 bigint, w2 bigint"), "windows")
    least = each.groupBy("w1", "w2").agg(F.min("id").alias("first"))
    told = each.join(least, ["w1", "w2"]).groupBy("vid").agg(F.sort_array(F.collect_set(F.struct("place", "first"))).alias("all"))
    return told.select("vid", F.col("all.first").alias("firsts"))


def _decisions(docs: DataFrame, window: int) -> DataFrame:
    """`(id, starts, hashes, mask)`: of a segment of an id, at its places, the windows (bits, from the first) that an earlier one holds."""
    spark = docs.sparkSession
    table = spark.table(bucketed(segments(docs, window), "segments", ["anchor"]))
    full = F.pow(F.lit(2), F.col("windows")).cast("int") - 1
    twins = table.filter("covered").select("id", "starts", "hashes", full.alias("mask"))
    rows = table.filter("not covered")
    shared = rows.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).filter("low < high")
    met = written(rows.join(shared, "anchor").select(*rows.columns, "low", (F.col("s0") != F.col("s1")).alias("differ")).filter("differ or id > low"), "shared-segments")
    equal = met.filter("not differ").select("id", "starts", "hashes", full.alias("mask"))
    parts = met.filter("differ")
    h1, h2 = (F.coalesce(F.get("hashes", F.lit(k)), F.lit(0).cast("bigint")).alias(f"h{k + 1}") for k in (0, 1))
    first = F.min(F.struct("id", F.col("starts")[0].alias("start"), "windows", h1, h2)).alias("one")
    variants = parts.groupBy("anchor", "seg").agg(first).select("anchor", "seg", "one.*").withColumn("vid", F.monotonically_increasing_id())
    variants = written(variants, "variants")
    total = variants.count()
    if not total:
        return twins.unionByName(equal)
    crowded = variants.groupBy("anchor").agg(F.count("*").alias("n")).select("anchor", (F.col("n") > SHARD_SEGMENTS).alias("many"))
    contents = written(_contents(variants.join(crowded, "anchor"), docs, window), "contents")
    firsts = _firsts_by_automata(contents.filter("not many"), total, window).unionByName(_firsts_by_hashes(contents.filter("many"), window))
    told = written(variants.select("vid", "anchor", "seg").join(firsts, "vid").select("anchor", "seg", "firsts"), "firsts")
    bits = F.aggregate(
        F.sequence(F.lit(0), F.size("firsts") - 1),
        F.lit(0),
        lambda mask, i: mask + F.when(F.get("firsts", i) < F.col("id"), F.pow(F.lit(2), i).cast("int")).otherwise(0),
    )
    border = parts.join(told, ["anchor", "seg"]).select("id", "starts", "hashes", bits.alias("mask")).filter("mask <> 0")
    return twins.unionByName(equal).unionByName(border)


def _cuts(decisions: DataFrame) -> DataFrame:
    """`(id, h1, h2, _cuts)`: the decisions for each id and text."""
    zero = F.lit(0).cast("bigint")
    single = decisions.filter("hashes is null").select("id", zero.alias("h1"), zero.alias("h2"), "starts", "mask")
    places = decisions.filter("hashes is not null").select("id", "hashes", "mask", F.posexplode("starts").alias("k", "start"))
    h1, h2 = (F.get("hashes", F.col("k") * 2 + k).alias(f"h{k + 1}") for k in (0, 1))
    told = single.unionByName(places.select("id", h1, h2, F.array("start").alias("starts"), "mask"))
    return told.groupBy("id", "h1", "h2").agg(F.collect_list(F.struct("starts", "mask")).alias("_cuts"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """All columns of `docs`, the text without repeated passages, `n_words` (before) and `n_removed`.

    Words are runs of characters other than `[\\x20\\x09-\\x0D]`. A word goes if one of the windows of `window` words that cover it also starts
    in a document with a smaller id; windows are those of the input. A text that loses words becomes its other words with a space between;
    all others stay as they are. Null texts stay null and have no words; texts shorter than a window lose nothing. Rows with the same id
    are not earlier than each other; rows without an id come last. Columns named `n_words` or `n_removed` are replaced.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", text.lower())]
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))
    repeated = _repeated_ids(docs, key)
    slim = _keyed(docs.select(key.alias("id"), F.col(text).alias("text")), repeated)
    with scratch(docs.sparkSession):
        decisions = written(_decisions(slim, window), "decisions", keep=True)
    rows = docs.select(
        key.alias("id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text).isNull().alias("_null"), F.col(text).alias("text")
    )
    rows = _keyed(rows, repeated)
    joined = _packed(rows).join(_cuts(decisions), ["id", "h1", "h2"], "left").select("_row", "_null", "packed", "_cuts")
    schema = T.StructType(
        [joined.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType())]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(window - GRAM + 1)
        for batch in _unpacked(batches):
            data, bounds = buffers(batch.column("text"))
            begins, ends = runs(~SPACES[data], bounds)
            offsets = np.searchsorted(begins, bounds)
            cut_of, (starts, masks) = _listed(batch.column("_cuts"), ["starts", "mask"])
            place_of, places = _places(starts)
            at = (offsets[:-1][cut_of[place_of]] + places)[:, None] + bits
            held = (masks.to_numpy()[place_of][:, None] >> bits & 1).astype(bool)
            first = at[held]
            change = np.bincount(first, minlength=len(begins) + 1) - np.bincount(first + window, minlength=len(begins) + 1)
            gone = np.cumsum(change)[: len(begins)] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[offsets[1:]] - total[offsets[:-1]]
            texts = batch.column("text").to_pylist()
            whole = data.tobytes()
            for i in np.flatnonzero(removed).tolist():
                own = slice(offsets[i], offsets[i + 1])
                kept = ~gone[own]
                texts[i] = b" ".join(map(whole.__getitem__, map(slice, begins[own][kept].tolist(), ends[own][kept].tolist())))
            for i in np.flatnonzero(batch.column("_null").to_numpy(zero_copy_only=False)).tolist():
                texts[i] = None
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed.astype(np.int64))],
                schema.names,
            )

    done = map_arrow(joined, remove, schema)
    order = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c == text or c in columns]
    return done.select(*order, F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"))
