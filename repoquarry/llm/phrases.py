"""Phrase collocations from an FM-index per shard over word ids.

A shard holds the words of some documents of one language as ids, with a separator between pieces. Its forward and its backward BWT
are kept together: every phrase is a pair of intervals, the right neighbours of a phrase are the symbols its backward interval spans,
and extending by one of them gives both intervals of the longer phrase. Counts of a shard are interval sizes and are summed over all
shards in two steps: first the counts of cells that phrases fall into by a hash, about a byte for each, then those of the phrases in cells that
are frequent; a phrase occurs no more often than its cell, so none is missed. The depth grows by one word a round: a phrase of d words
is extended only where its first and its last d - 1 words are frequent in the whole language. Words outside every frequent phrase
become separators, so the indexes shrink from round to round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.tables import discard, kept_apart, map_arrow, scratch, ship, written
from repoquarry.llm.texts import buffers, distinct, filled, give_back, mix, runs, slices
from repoquarry.operators.skew import first_rows

UNKNOWN = "und"
SHARD_BYTES = 4_000_000
"""Text of one language that makes a shard; a task gives out all it holds back when that is twice as much."""
PART_PHRASES = 4_000_000
"""Occurrences of phrases, in all shards, whose counts a task sums at once."""
CELLS = 8
"""Cells for each phrase that could be frequent at most: so no more than one cell in eight is (a least count below 16 counts as 16)."""

_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\v\f\r")] = True

_STATE = "shard bigint, lang string, words int, symbols binary, marks binary, size int, packed binary, total bigint"
_CELLS = "part int, shard bigint, size int, packed binary"
_LISTED = "part int, shard bigint, lang string, size int, packed binary"
_NAMED = "shard bigint, size int, packed binary, lang string, gids array<bigint>, first array<bigint>, rest array<bigint>, counts array<bigint>"
_WORDS = "shard bigint, size int, packed binary, lang string, gids array<bigint>, words array<string>, counts array<bigint>"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _row(schema: str, **given) -> pa.RecordBatch:
    """One row of the schema; numpy arrays are lists, what is not given is null."""
    names, columns = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        value = given.get(name)
        if kind.startswith("array<"):
            kind = _ARROW[kind[6:-1]]
            column = pa.nulls(1, pa.list_(kind)) if value is None else pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value if isinstance(value, pa.Array) else pa.array(value, kind))
        else:
            column = pa.array([value], _ARROW[kind])
        names.append(name)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names)


class Half(NamedTuple):
    """One direction of the index: `order` sorts the suffixes by their first symbols, `before` is the symbol ahead of each, `step` (LF)
    the row of the suffix that begins with it, `begins` the first row of each symbol."""

    order: np.ndarray
    before: np.ndarray
    step: np.ndarray
    begins: np.ndarray


def half_index(symbols: np.ndarray, depth: int) -> Half:
    """Suffixes sorted by `depth` symbols at least: phrases of up to `depth` words are intervals."""
    n = len(symbols)
    rank, width = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        width *= 2
    before = symbols[order - 1]
    step = np.empty(n, np.int64)
    # Suffixes that begin alike keep the order of what follows them.
    step[np.argsort(before, kind="stable")] = np.arange(n)
    begins = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
    return Half(order, before, step, begins)


class Phrases(NamedTuple):
    """Phrases of one length: their intervals in the forward and the backward index."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray


class PhraseIndex:
    """Bidirectional FM-index of one shard. Symbol 0 parts pieces; phrases hold none of it."""

    def __init__(self, symbols: np.ndarray, depth: int):
        # A piece begins and ends at a separator, so the text can be read as a ring.
        self.symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
        self.forward = half_index(self.symbols, depth)
        self.backward = half_index(self.symbols[::-1], depth)

    def words(self) -> Phrases:
        low, high = self.forward.begins[1:-1], self.forward.begins[2:]
        there = high > low
        return Phrases(low[there], low[there], (high - low)[there])

    def extend_right(self, phrases: Phrases) -> tuple[Phrases, np.ndarray]:
        """All phrases one word longer, and the index of the phrase each extends."""
        node = np.repeat(np.arange(len(phrases.size)), phrases.size)
        inside = np.arange(len(node)) - np.repeat(np.cumsum(phrases.size) - phrases.size, phrases.size)
        rows = phrases.back[node] + inside
        after = self.backward.before[rows]
        by = np.argsort(node * (len(self.forward.begins) + 1) + after, kind="stable")
        node, after, rows = node[by], after[by], rows[by]
        new = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (after[1:] != after[:-1]))) if len(node) else np.zeros(0, bool))
        size = np.diff(np.append(new, len(node)))
        parent = node[new]
        # Smaller symbols of the same phrase come before in the forward interval.
        low = phrases.low[parent] + new - np.searchsorted(node, parent)
        longer, kept = Phrases(low, self.backward.step[rows[new]], size), after[new] > 0
        return Phrases(*[values[kept] for values in longer]), parent[kept]

    def places(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in the text, and the index of the phrase."""
        node = np.repeat(np.arange(len(phrases.size)), phrases.size)
        inside = np.arange(len(node)) - np.repeat(np.cumsum(phrases.size) - phrases.size, phrases.size)
        return self.forward.order[phrases.low[node] + inside], node

    def first_places(self, phrases: Phrases) -> np.ndarray:
        return self.forward.order[phrases.low]


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of all texts as numbers from 1 into the table of distinct words, 0 between pieces; A-Z in lower case."""
    data, offsets = buffers(filled(texts))
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    breaks = _BREAKS[data]
    begins, ends = runs(~(breaks | _BLANKS[data]), offsets)
    codes, table = distinct(data, begins, ends)
    if not len(codes):
        return np.zeros(0, np.int32), table
    piece = np.cumsum(breaks)[begins] + np.searchsorted(offsets, begins, side="right")
    new = np.concatenate(([False], piece[1:] != piece[:-1]))
    symbols = np.zeros(len(codes) + int(new.sum()), np.int32)
    symbols[np.arange(len(codes)) + np.cumsum(new)] = codes + 1
    return symbols, table


def _planes(numbers: np.ndarray) -> bytes:
    """First the lowest bytes of all numbers, then the next ones, so that the high ones, mostly zero, take no room when packed."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, size: int, at: int = 0) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, width * size, at).reshape(width, size).T).view(kind).reshape(size)


def _packed_words(table: pa.Array, *columns: np.ndarray) -> bytes:
    """Words and a whole number or more for each."""
    data, offsets = buffers(table)
    whole = b"".join([_planes(np.diff(offsets).astype("<i4")), *[_planes(c.astype("<i8")) for c in columns], data.tobytes()])
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked_words(packed: bytes, size: int, columns: int = 1) -> tuple[pa.Array, list[np.ndarray]]:
    whole = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    offsets = np.concatenate(([0], np.cumsum(_from_planes(whole, "<i4", size)))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(whole[(4 + 8 * columns) * size :])])
    return words, [_from_planes(whole, "<i8", size, (4 + 8 * k) * size) for k in range(columns)]


def _shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Shards of the documents of one language, made inside each task: the text and its words, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        made = 0
        task = TaskContext.get().partitionId()

        def flush(names: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name in names:
                sizes.pop(name)
                symbols, table = symbols_of(pa.concat_arrays(held.pop(name)))
                counts = np.bincount(symbols, minlength=len(table) + 1)[1:]
                order = np.argsort(-counts, kind="stable")
                table, counts = table.take(pa.array(order)), counts[order]
                number = np.concatenate(([0], np.argsort(order) + 1))
                packed = {"size": len(table), "packed": _packed_words(table, counts), "total": int(counts.sum())}
                yield _row(_STATE, shard=(task << 32) + made, lang=name, words=len(symbols), symbols=_plain(number[symbols]), **packed)
                made += 1

        for batch in slices(batches, text, SHARD_BYTES):
            names = batch.column(lang).fill_null(UNKNOWN).dictionary_encode()
            for number, name in enumerate(names.dictionary.to_pylist()):
                part = filled(batch.column(text).filter(pc.equal(names.indices, number)))
                # A copy that holds no more than these texts.
                part = pa.concat_arrays([part, pa.array([], pa.binary())])
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + part.nbytes
                if sizes[name] >= SHARD_BYTES:
                    yield from flush([name])
            if sum(sizes.values()) >= 2 * SHARD_BYTES:
                yield from flush(list(held))
        yield from flush(list(held))

    return map_arrow(docs.select(F.col(text), F.col(lang).cast("string")), run, _STATE)


def _listed(row: dict, length: int) -> tuple[pa.Array | list[np.ndarray], np.ndarray, np.ndarray]:
    """The words or the phrases (both names) of a shard, how often each occurs there, and a hash of each."""
    if length == 1:
        words, (counts,) = _unpacked_words(row["packed"], row["size"])
        seed = zlib.crc32(row["lang"].encode())
        return words, counts, np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)
    first, rest, counts = _expanded(row["packed"], row["size"], 3)
    with np.errstate(over="ignore"):
        return [first, rest], np.diff(counts, prepend=0), mix(first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.view(np.uint64))


def _parts(known: DataFrame) -> int:
    return max(1, -(-(known.agg(F.sum("total")).first()[0] or 0) // PART_PHRASES))


def _likely(known: DataFrame, length: int, min_count: int, parts: int) -> DataFrame:
    """The entries of all shards, packed by part, of phrases whose cell occurs `min_count` times: `(part, shard, lang, size, packed)`.

    A part is a run of cells. Shards send the counts of their cells to the task of the part, which answers every shard with a bit for each
    cell it sent; these pick what is sent whole. Entries are the numbers of the phrases in their shard and what `_listed` gives.
    """
    listed = known.filter("size > 0").select("shard", "lang", "size", "packed")
    width = CELLS * PART_PHRASES // max(min_count, 16)

    def cells_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Different cells in order, that of each phrase among them, and the runs of one part."""
        cells, cell_at = np.unique(hashes % np.uint64(parts * width), return_inverse=True)
        cells = cells.astype(np.int64)
        return cells, cell_at, _runs(cells // width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, counts, hashes = _listed(row, length)
                cells, cell_at, spans = cells_of(hashes)
                sums = np.minimum(np.bincount(cell_at, counts), min_count).astype(np.int64)  # less than 2^53
                place = cells % width
                rows = [
                    _row(_CELLS, part=int(cells[a] // width), shard=row["shard"], size=b - a, packed=_squeezed(place[a:b], np.cumsum(sums[a:b])))
                    for a, b in spans
                ]
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        sums, rows = np.zeros(width, np.int64), []
        sent = [table.column(c).to_pylist() for c in ("shard", "size", "packed")]
        for _, size, packed in zip(*sent, strict=True):
            place, counts = _expanded(packed, size, 2)
            sums[place] += np.diff(counts, prepend=0)
        often = sums >= min_count
        for shard, size, packed in zip(*sent, strict=True):
            bits = often[_expanded(packed, size, 2)[0]]
            if bits.any():
                rows.append(_row(_CELLS, part=key[0].as_py(), shard=shard, size=size, packed=pa.compress(np.packbits(bits).tobytes(), codec="zstd", asbytes=True)))
        return pa.Table.from_batches(rows or [_row(_CELLS).slice(0, 0)]).combine_chunks()

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            values, counts, hashes = _listed(row, length)
            cells, cell_at, spans = cells_of(hashes)
            span_of = {int(cells[a] // width): (a, b) for a, b in spans}
            often = np.zeros(len(cells), bool)
            for got in right.to_pylist():
                a, b = span_of[got["part"]]
                bits = pa.decompress(got["packed"], decompressed_size=-(-got["size"] // 8), codec="zstd", asbytes=True)
                often[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
            node = np.flatnonzero(often[cell_at])
            part = cells[cell_at[node]] // width
            order = np.argsort(part, kind="stable")
            node, part = node[order], part[order]
            for a, b in _runs(part):
                at = node[a:b]
                if length == 1:
                    packed = _packed_words(values.take(pa.array(at)), at, counts[at])
                else:
                    packed = _squeezed(at, values[0][at], values[1][at], np.cumsum(counts[at]))
                rows.append(_row(_LISTED, part=int(part[a]), shard=row["shard"], lang=row["lang"], size=b - a, packed=packed))
        result = pa.Table.from_batches(rows or [_row(_LISTED).slice(0, 0)]).combine_chunks()
        give_back()
        return result

    answers = map_arrow(listed, count, _CELLS).groupBy("part").applyInArrow(answer, _CELLS).withColumnRenamed("shard", "_shard")
    return listed.groupBy("shard").cogroup(answers.groupBy("_shard")).applyInArrow(pick, _LISTED)


def _frequent_words(entries: DataFrame, min_count: int, parts: int) -> DataFrame:
    """Sums of the words of all shards, part by part: rows with a shard name its frequent words (packed nodes and names), those without
    list the frequent words of a language. More frequent words have smaller names, so phrases pack closer."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, taken = [], 0
        langs = table.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            chosen = table.filter(pc.equal(table.column("lang"), lang))
            sizes = chosen.column("size").to_numpy()
            lists = [_unpacked_words(p.as_py(), n, 2) for p, n in zip(chosen.column("packed"), sizes.tolist(), strict=True)]
            coded = pa.concat_arrays([w for w, _ in lists]).dictionary_encode()
            codes = coded.indices.to_numpy()
            sums = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(sums, codes, np.concatenate([c for _, (_, c) in lists]))
            often = np.flatnonzero(sums >= min_count)
            often = often[np.argsort(-sums[often], kind="stable")]
            names = np.zeros(len(sums), np.int64)
            names[often] = (taken + np.arange(len(often))) * parts + key[0].as_py() + 1
            taken += len(often)
            words = coded.dictionary.take(pa.array(often)).cast(pa.string())
            rows.append(_row(_WORDS, lang=lang, gids=names[often], words=words, counts=sums[often]))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            node = np.concatenate([n for _, (n, _) in lists])
            name = names[codes]
            kept = name > 0
            owner, node, name = owner[kept], node[kept], name[kept]
            shards = chosen.column("shard").to_numpy()
            for a, b in _runs(owner):
                rows.append(_row(_WORDS, shard=int(shards[owner[a]]), size=b - a, packed=_squeezed(node[a:b], name[a:b])))
        result = pa.Table.from_batches(rows).combine_chunks()
        give_back()
        return result

    return entries.groupBy("part").applyInArrow(run, _WORDS)


def narrowed(symbols: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and labels without what lies outside the labelled phrases of `width` words; a gap is one separator."""
    covered = labels > 0
    for shift in range(1, width):
        covered[shift:] |= labels[:-shift] > 0
    kept = covered.copy()
    kept[1:] |= covered[:-1]
    symbols = np.where(covered, symbols, 0)[kept]
    return np.unique(np.concatenate(([0], symbols)), return_inverse=True)[1][1:].astype(np.int32), np.where(covered, labels, 0)[kept]


def _squeezed(*columns: np.ndarray) -> bytes:
    """Whole numbers as the differences to the one before, small ones either way of zero in few bytes."""
    steps = [np.diff(c.astype(np.int64), prepend=0) for c in columns]
    return pa.compress(b"".join(_planes(((d << 1) ^ (d >> 63)).astype("<i8")) for d in steps), codec="zstd", asbytes=True)


def _expanded(packed: bytes, size: int, columns: int) -> list[np.ndarray]:
    data = pa.decompress(packed, decompressed_size=8 * columns * size, codec="zstd", asbytes=True) if size else b""
    folded = [_from_planes(data, "<u8", size, 8 * k * size) for k in range(columns)]
    return [np.cumsum((f >> np.uint64(1)).view(np.int64) ^ -(f & np.uint64(1)).view(np.int64)) for f in folded]


def _plain(numbers: np.ndarray) -> bytes:
    """32-bit numbers from -1 in no order."""
    return pa.compress(_planes((numbers + 1).astype("<u4")), codec="zstd", asbytes=True)


def _numbers(packed: bytes, size: int) -> np.ndarray:
    data = pa.decompress(packed, decompressed_size=4 * size, codec="zstd", asbytes=True) if size else b""
    return _from_planes(data, "<u4", size).astype(np.int64) - 1


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every run of equal numbers (0 or more)."""
    begins = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
    return list(zip(begins, [*begins[1:], len(numbers)][: len(begins)], strict=True))


def pair_numbers(symbols: np.ndarray) -> np.ndarray:
    """For each word the number of the pair that begins there among all different ones in order; -1 where none does."""
    numbers = np.full(len(symbols), -1, np.int64)
    at = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
    numbers[at] = np.unique(symbols[at].astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols[at + 1], return_inverse=True)[1]
    return numbers


def _longer(state: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """What every shard knows after phrases of `length` words have been counted in it.

    `found(shard, size, packed)` names the phrases of one word less that are frequent in the language. The state of a shard is its text and, for each
    word, the number (node) of the phrase that begins there; marks of words and of pairs follow from the text and are not kept. The
    phrases are packed in order: the names of the phrase without its last and without its first word, and how often it occurs here.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            n = left.column("words")[0].as_py()
            symbols = _numbers(left.column("symbols")[0].as_py(), n)
            if length == 2:
                marks = symbols - 1
            else:
                marks = pair_numbers(symbols) if length == 3 else _numbers(left.column("marks")[0].as_py(), n)
            names = np.zeros(int(marks.max(initial=-1)) + 2, np.int64)  # the last one: no phrase
            for size, packed in zip(right.column("size"), right.column("packed"), strict=True):
                node, name = _expanded(packed.as_py(), size.as_py(), 2)
                names[node] = name
            # Words are numbered in the order of their names from the first round on, so pairs come in the order of both names.
            symbols, labels = narrowed(names[marks] if length == 2 else symbols, names[marks], length - 1)
            marked, first, rest, counts = count_longer(symbols, labels, length)
            order = np.lexsort((rest, first))
            first, rest, counts = (values[order] for values in (first, rest, counts))
            marks = None if length == 2 else _plain(np.append(np.argsort(order), -1)[marked])
            own = {"shard": left.column("shard")[0].as_py(), "lang": left.column("lang")[0].as_py()}
            packed = {"size": len(first), "packed": _squeezed(first, rest, np.cumsum(counts)), "total": int(counts.sum())}
            rows.append(_row(_STATE, **own, words=len(symbols), symbols=_plain(symbols), marks=marks, **packed))
        result = pa.Table.from_batches(rows or [_row(_STATE).slice(0, 0)]).combine_chunks()
        give_back()
        return result

    ship(state.sparkSession)
    named = found.select(F.col("shard").alias("_shard"), "size", "packed")
    return state.groupBy("shard").cogroup(named.groupBy("_shard")).applyInArrow(run, _STATE)


def count_longer(symbols: np.ndarray, labels: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of `length` words whose first and last `length` - 1 words have a label: for each word the number of the phrase that begins
    there (-1: none); for each phrase both labels and its count."""
    index = PhraseIndex(symbols, length)
    label_at = np.concatenate(([0], labels, [0, 0]))  # as the index has a separator in front
    phrases = index.words()
    for _ in range(length - 2):
        phrases, _ = index.extend_right(phrases)
    own = label_at[index.first_places(phrases)]
    phrases, own = Phrases(*[values[own > 0] for values in phrases]), own[own > 0]
    longer, parent = index.extend_right(phrases)
    rest = label_at[index.first_places(longer) + 1]
    longer, parent, rest = Phrases(*[values[rest > 0] for values in longer]), parent[rest > 0], rest[rest > 0]
    marked = np.full(len(symbols) + 2, -1, np.int64)
    places, node = index.places(longer)
    marked[places] = node
    return marked[1:-1], own[parent], rest, longer.size.astype(np.int64)


def _frequent(entries: DataFrame, min_count: int) -> DataFrame:
    """Sums of all shards, part by part: rows with a shard name its frequent phrases (packed nodes and names), those without list the frequent
    phrases of a language `(lang, gids, first, rest, counts)`. Names follow from the part, so a task that runs again gives the same."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        lists = [_expanded(p.as_py(), n, 4) for p, n in zip(table.column("packed"), sizes.tolist(), strict=True)]
        node, first, rest, counts = (np.concatenate(c) for c in zip(*[(n, f, r, np.diff(c, prepend=0)) for n, f, r, c in lists], strict=True))
        del lists
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rest, first))
        first, rest, owner, node = first[order], rest[order], owner[order], node[order]
        begins = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1]))))
        sums = np.add.reduceat(counts[order], begins)
        often = sums >= min_count
        names = np.where(often, (key[0].as_py() << 32) + np.cumsum(often), 0)
        rows = []
        langs = np.array(table.column("lang").to_pylist(), object)[owner[begins]]
        for lang in sorted(set(langs[often])):
            chosen = often & (langs == lang)
            at = begins[chosen]
            rows.append(_row(_NAMED, lang=lang, gids=names[chosen], first=first[at], rest=rest[at], counts=sums[chosen]))
        name = np.repeat(names, np.diff(np.append(begins, len(first))))
        kept = name > 0
        by = np.argsort(owner[kept], kind="stable")
        owner, node, name = owner[kept][by], node[kept][by], name[kept][by]
        shards = table.column("shard").to_numpy()
        for a, b in _runs(owner):
            rows.append(_row(_NAMED, shard=int(shards[owner[a]]), size=b - a, packed=_squeezed(node[a:b], name[a:b])))
        result = pa.Table.from_batches(rows or [_row(_NAMED).slice(0, 0)]).combine_chunks()
        give_back()
        return result

    return entries.groupBy("part").applyInArrow(run, _NAMED)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to `longest` words that occur `min_count` times in their language, and the words per language.

    Phrases: `(lang, words, prefixes, suffixes, f, inside)`; `prefixes[k]` and `suffixes[k]` count the first and the last k + 1 words, and
    `inside` says that a phrase one word longer occurs just as often. Totals: `(lang, n)`. A null text is empty, a null language `und`.
    Only words and phrases in frequent cells are sent to be summed.
    """
    with scratch(docs.sparkSession):
        known = kept_apart(_shards(docs, text, lang), "phrase-shards", "shard")
        totals = written(known.groupBy("lang").agg(F.sum("total").alias("n")).filter("n > 0"), "phrase-totals", keep=True)
        parts = _parts(known)
        words = written(_frequent_words(_likely(known, 1, min_count, parts), min_count, parts), "phrase-words")
        found = words.filter("shard is not null").select("shard", "size", "packed")
        entry = F.explode(F.arrays_zip("gids", "words", "counts")).alias("entry")
        grams = words.filter("shard is null").select("lang", entry).select("lang", F.col("entry.gids").alias("gid"), "entry.words", F.col("entry.counts").alias("f"))
        one = F.array("f")
        level = grams.select("gid", "lang", F.array("words").alias("words"), one.alias("prefixes"), one.alias("suffixes"), "f")
        levels = []
        for length in range(2, longest + 1):
            state = known.select("shard", "lang", "words", "symbols", "marks")
            before, known = known, kept_apart(_longer(state, found, length), f"phrase-state-{length}", "shard")
            discard(before)
            sums = written(_frequent(_likely(known, length, min_count, _parts(known)), min_count), f"phrase-sums-{length}")
            found = sums.filter("shard is not null").select("shard", "size", "packed")
            entry = F.explode(F.arrays_zip("gids", "first", "rest", "counts")).alias("entry")
            of_lang = sums.filter("shard is null").select("lang", entry)
            grams = of_lang.select("lang", F.col("entry.gids").alias("gid"), "entry.first", "entry.rest", F.col("entry.counts").alias("f"))
            ahead = level.select(F.col("gid").alias("first"), F.col("words").alias("_words"), F.col("prefixes").alias("_prefixes"))
            behind = level.select(F.col("gid").alias("rest"), F.element_at("words", -1).alias("_last"), F.col("suffixes").alias("_suffixes"))
            longer = written(
                grams.join(ahead, "first").join(behind, "rest").select(
                    "gid",
                    "lang",
                    F.array_append("_words", F.col("_last")).alias("words"),
                    F.concat("_prefixes", one).alias("prefixes"),
                    F.concat("_suffixes", one).alias("suffixes"),
                    "f",
                ),
                f"phrase-level-{length}",
            )
            around = grams.select(F.explode(F.array("first", "rest")).alias("gid"), F.col("f").alias("_around")).groupBy("gid").agg(F.max("_around").alias("_around"))
            inside = F.coalesce(F.col("_around") >= F.col("f"), F.lit(False))
            levels.append(written(level.join(around, "gid", "left").withColumn("inside", inside).drop("_around"), f"phrase-judged-{length}"))
            level = longer
        levels.append(level.withColumn("inside", F.lit(False)))
        result = reduce(DataFrame.unionByName, levels)
        return written(result.drop("gid"), "phrases", keep=True), totals


def _cuts(longest: int) -> Column:
    """`(score, cut, l, r)` of every cut, lowest score first, then the shorter first part."""
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.element_at("prefixes", k), F.element_at("suffixes", F.size("words") - k)
        top = (F.lit(1000).cast("decimal(4,0)") * wide(F.col("f"))).cast("decimal(38,0)") * wide(F.col("n"))
        score = F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the `top` phrases of every language by their weakest cut.

    Words are split at blanks and tabs within pieces that end at `. , ; : ! ?` and line ends, A-Z in lower case. A phrase of 2 to
    `longest` words that occurs `a` times scores floor(1000 * a * n / (l * r)) at the cut (the first of the lowest) into parts that occur
    l and r times. Phrases inside a longer one that occurs as often are left out: if any longer one does, one of one word more does.
    Scores are exact in decimals of 38 digits. Ties go to more frequent phrases, then by bytes. Repeated rows count again; columns with
    other names do not matter; an empty table has no phrases.
    """
    phrases, totals = frequent_phrases(docs, text, lang, min_count, longest)
    candidates = phrases.filter((F.size("words") > 1) & ~F.col("inside")).join(totals, "lang")
    scored = candidates.withColumn("_cut", _cuts(longest)).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "_cut.l", "_cut.r", "n", "_cut.score"
    )
    ranked = first_rows(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
