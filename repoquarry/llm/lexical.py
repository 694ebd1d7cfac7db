"""Ranked lexical search with Block-Max MaxScore over document shards.

The index holds, for every shard and term, the postings in compressed blocks, with the last document and the highest impact of each
block beside them. A search sorts the lists of an item by their bounds: lists that together cannot lift a document above the k-th best
score so far are not essential. Only documents of essential lists become candidates; on the other lists the maximum of a candidate's
block decides whether the block is decompressed at all. Documents of a shard lie in the order of their ids, so of equal scores the first
found stays. The best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.llm.tables import map_arrow, ship, written
from repoquarry.llm.texts import buffers, distinct, filled, runs, slices

SHARD_BYTES = 12_000_000
"""Text of a shard; a longer single text is a shard of its own."""
BLOCK = 128
"""Postings of a block."""
ITEM_TERMS = 100_000
"""About as many terms of items are searched by a task at once."""
_WINDOW = 4096

_TERM_BYTES = np.zeros(256, bool)
_TERM_BYTES[0x30:0x3A] = _TERM_BYTES[0x41:0x5B] = _TERM_BYTES[0x61:0x7B] = _TERM_BYTES[0x80:] = True

_INDEX = "shard bigint, term string, n_docs int, last array<int>, top array<int>, blocks array<binary>, ids array<bigint>, lengths array<bigint>"
_INDEX_ARROW = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("last", pa.list_(pa.int32())), ("top", pa.list_(pa.int32()))]
    + [("blocks", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of all texts as numbers into the table of distinct terms, that table, and the first term of each text (the end comes last).

    A term is a maximal run of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case; a null text has none.
    """
    data, offsets = buffers(filled(texts))
    data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
    begins, ends = runs(_TERM_BYTES[data], offsets)
    codes, table = distinct(data, begins, ends)
    return codes.astype(np.int64), table, np.searchsorted(begins, offsets)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, low ones first, the last byte of a value below 128; and where each value begins."""
    wide = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        wide += values >> bits > 0
    begins = np.concatenate(([0], np.cumsum(wide)))
    which = np.repeat(np.arange(len(values)), wide)
    place = np.arange(begins[-1]) - begins[which]
    more = place < wide[which] - 1
    return ((values[which] >> 7 * place) & 127 | more * 128).astype(np.uint8), begins


def _values(data: np.ndarray) -> np.ndarray:
    ends = data < 128
    begins = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1)) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins) if len(data) else np.zeros(0, np.int64)


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term found `times` times in a document of `lengths` terms brings to its score, before the term's weight."""
    measure = 25 + 75 * lengths * n_docs // n_terms
    return 1_000_000_000 * times // (1000 * times + 8 * measure)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _shard_rows(shard: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Index rows of one shard: one for each term, and one without a term that holds the ids and lengths of the documents."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    codes, table, offsets = terms_of(texts)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(ids)), lengths)
    posting, times = np.unique(codes * max(1, len(ids)) + doc, return_counts=True)
    code, doc = np.divmod(posting, max(1, len(ids)))
    first = np.searchsorted(code, np.arange(len(table) + 1))
    place = np.arange(len(code)) - first[code]
    begins = np.flatnonzero(place % BLOCK == 0)
    block_ends = np.append(begins[1:], len(code))
    ahead = np.diff(doc, prepend=0)
    ahead[begins] = doc[begins]
    pairs = np.empty(2 * len(code), np.int64)
    pairs[0::2], pairs[1::2] = ahead, times
    data, starts = _varints(pairs)
    impact = impacts(times, lengths[doc], n_docs, max(1, n_terms))
    top = np.maximum.reduceat(impact, begins) if len(begins) else impact
    of_term = np.searchsorted(code[begins], np.arange(len(table) + 1))
    bounds = np.append(starts[2 * begins], starts[-1]).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    # The row of documents comes last: its lists of blocks are empty.
    of_term = np.append(of_term, of_term[-1])
    n = len(table)
    none = np.zeros(n + 1, np.int64)
    whole = np.append(none, len(ids))
    columns = [
        pa.array(np.full(n + 1, shard)),
        pa.concat_arrays([table.cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.append(np.diff(first), 0), pa.int32()),
        _lists(of_term, pa.array(doc[block_ends - 1], pa.int32())),
        _lists(of_term, pa.array(top, pa.int32())),
        _lists(of_term, blocks),
        _lists(whole, ids.cast(pa.int64())),
        _lists(whole, pa.array(lengths, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_INDEX_ARROW)


class LexicalIndex(NamedTuple):
    """Rows of all shards, documents that hold a term, and all their terms with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
    """Index of all rows; shards are made inside the tasks that read the texts, so texts are not shuffled.

    Rows that repeat an id are documents of their own. A null text has no term. The first pass counts documents and terms, as block
    maxima depend on the mean length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, offsets = buffers(filled(batch.column(text)))
            begins, _ = runs(_TERM_BYTES[data], offsets)
            lengths = np.diff(np.searchsorted(begins, offsets))
            yield pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], ["d", "t"])

    totals = map_arrow(docs.select(F.col(text)), count, "d bigint, t bigint").agg(F.sum("d"), F.sum("t")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for made, batch in enumerate(slices(batches, "text", shard_bytes)):
            rows = _shard_rows((task << 32) + made, batch.column("id"), filled(batch.column("text")), n_docs, n_terms)
            for at in range(0, rows.num_rows, 20_000):
                yield rows.slice(at, 20_000)

    given = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return LexicalIndex(written(map_arrow(given, shards, _INDEX), "lexical-index"), n_docs, n_terms)


class Postings:
    """One term of one shard."""

    def __init__(self, n_docs: int, last: np.ndarray, top: np.ndarray, blocks: list[bytes]):
        self.n_docs, self.last, self.top, self.blocks = n_docs, last, top, blocks
        self._whole = None

    def decoded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and times of the chosen blocks."""
        pairs = _values(np.frombuffer(b"".join([self.blocks[i] for i in which]), np.uint8))
        ahead, times = pairs[0::2], pairs[1::2]
        full = np.arange(len(which)) * BLOCK  # only the last block of all may be shorter
        total = np.cumsum(ahead)
        before = np.repeat(total[full] - ahead[full], np.diff(np.append(full, len(ahead))))
        return total - before, times

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self._whole is None:
            self._whole = self.decoded(np.arange(len(self.blocks)))
        return self._whole


class Shard:
    """Postings of the wanted terms of one shard; counts decompressed blocks."""

    def __init__(self, lists: dict[str, Postings], lengths: np.ndarray, n_docs: int, n_terms: int):
        self.lists, self.lengths, self.n_docs, self.n_terms = lists, lengths, n_docs, n_terms
        self.decompressed = 0

    def _impacts(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        return impacts(times, self.lengths[docs], self.n_docs, self.n_terms)

    def best(self, weights: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (numbers in the shard) with scores above 0, best first, ties by number."""
        wanted = [(int(w) * int(self.lists[t].top.max()), int(w), self.lists[t]) for t, w in weights.items() if t in self.lists and w > 0]
        wanted.sort(key=lambda x: x[0])
        bounds = np.cumsum([0] + [bound for bound, _, _ in wanted])  # of all lists before
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bar, essential, low, width = 0, 0, 0, _WINDOW // 8
        while low < len(self.lengths):
            while essential < len(wanted) and bounds[essential + 1] <= bar:
                essential += 1
            if essential == len(wanted):
                break
            high = min(low + width, len(self.lengths))
            docs, sums = self._candidates(wanted, bounds, essential, low, high, bar)
            found, scores = np.concatenate((found, docs)), np.concatenate((scores, sums))
            pick = np.lexsort((found, -scores))[:k]
            found, scores = found[pick], scores[pick]
            if len(found) == k:
                bar = scores[-1]
            low, width = high, min(2 * width, _WINDOW)
        return found, scores

    def _candidates(self, wanted, bounds, essential: int, low: int, high: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from `low` to `high` with scores above the bar, from essential lists; the others only complete their scores."""
        sums = np.zeros(high - low, np.int64)
        for _, weight, held in wanted[essential:]:
            if held._whole is None:
                self.decompressed += len(held.blocks)
            docs, times = held.whole()
            at = slice(*np.searchsorted(docs, (low, high)))
            sums[docs[at] - low] += weight * self._impacts(docs[at], times[at])
        docs = np.flatnonzero(sums)
        sums, docs = sums[docs], docs + low
        for number in range(essential - 1, -1, -1):
            _, weight, held = wanted[number]
            hopeful = sums + bounds[number + 1] > bar
            docs, sums = docs[hopeful], sums[hopeful]
            block = np.searchsorted(held.last, docs)
            there = block < len(held.last)
            top = np.where(there, weight * held.top[np.minimum(block, len(held.last) - 1)].astype(np.int64), 0)
            hopeful = sums + top + bounds[number] > bar
            docs, sums, block, there = docs[hopeful], sums[hopeful], block[hopeful], there[hopeful]
            needed = np.unique(block[there])
            if len(needed):
                if held._whole is None:
                    self.decompressed += len(needed)
                listed, times = held.whole() if held._whole is not None else held.decoded(needed)
                at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                hit = listed[at] == docs
                sums[hit] += weight * self._impacts(docs[hit], times[at[hit]])
        over = sums > bar
        return docs[over], sums[over]


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`(item_id, term, times)`. Rows that repeat an id are one item, with the text that comes first."""
    once = items.groupBy(F.col(item_id).cast("bigint").alias("item_id")).agg(F.min(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, table, offsets = terms_of(batch.column("text"))
            item = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pair, times = np.unique(item * max(1, len(table)) + codes, return_counts=True)
            item, code = np.divmod(pair, max(1, len(table)))
            columns = [batch.column("item_id").take(pa.array(item)), table.cast(pa.string()).take(pa.array(code)), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    return map_arrow(once, run, "item_id bigint, term string, times bigint")


def term_weights(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """`(term, weight)` of the given terms that some document holds; a frequent term is one row per shard."""
    df = index.rows.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    ratio: Column = F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    return df.select("term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("weight"))


def search(index: LexicalIndex, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the k best documents of every item with a score above 0, ties by id (null comes last).

    Items are searched in blocks of about `ITEM_TERMS` terms; a task holds one shard's postings of the terms of one block. Items
    without a term of the index, empty tables and null texts give no rows.
    """
    terms = written(item_terms(items, item_id, text), "item-terms")
    blocks = max(1, -(-terms.count() // ITEM_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    weighted = written(terms.join(term_weights(index, terms), "term").select(block, "item_id", "term", (F.col("times") * F.col("weight")).alias("weight")), "item-weights")
    wanted = index.rows.join(weighted.select("block", "term").distinct(), "term").select("shard", "block", "term", "n_docs", "last", "top", "blocks")
    packed = weighted.groupBy("block").agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("asked"))
    shards = index.rows.filter("term is null").select(F.col("shard").alias("_shard"), "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sides = shards.join(packed, "block").select("_shard", F.col("block").alias("_block"), "ids", "lengths", "asked")
    n_docs, n_terms = index.n_docs, max(1, index.n_terms)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"item_id": [], "doc_id": [], "score": []}
        if left.num_rows and right.num_rows:
            lists = {}
            for batch in left.to_batches():
                last, top, data = (batch.column(c) for c in ("last", "top", "blocks"))
                edges = last.offsets.to_numpy()
                numbers = [last.values.to_numpy(), top.values.to_numpy()]
                for i, (term, size) in enumerate(zip(batch.column("term").to_pylist(), batch.column("n_docs").to_pylist(), strict=True)):
                    lists[term] = Postings(size, *[v[edges[i] : edges[i + 1]] for v in numbers], data[i].as_py())
            ids = right.column("ids").combine_chunks().flatten()
            shard = Shard(lists, right.column("lengths").combine_chunks().flatten().to_numpy(), n_docs, n_terms)
            asked = right.column("asked").combine_chunks().flatten()
            by_item: dict[int | None, dict[str, int]] = {}
            for item, term, weight in zip(*[asked.field(c).to_pylist() for c in ("item_id", "term", "weight")], strict=True):
                by_item.setdefault(item, {})[term] = weight
            for item, weights in by_item.items():
                docs, scores = shard.best(weights, k)
                out["item_id"] += [item] * len(docs)
                out["doc_id"] += ids.take(pa.array(docs)).to_pylist()
                out["score"] += scores.tolist()
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    ship(items.sparkSession)
    found = wanted.groupBy("shard", "block").cogroup(sides.groupBy("_shard", "_block")).applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
