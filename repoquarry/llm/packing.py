"""Best-fit packing planned on the histogram of lengths.

The plan sees counts only: lengths from long to short, each put into the fullest open sequences that still take it, as many at
a time as there are. So it costs the same for a thousand and for 10^12 pieces. Pieces then find their place by their rank among
the pieces of the same length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.llm.sentence_pieces import model_bytes
from repoquarry.llm.tables import map_arrow, written
from repoquarry.llm.texts import SPACES, buffers, distinct, filled, gather, runs, slices

_KNOWN: dict[int, dict[bytes, bytes]] = {}
MAX_KNOWN_WORDS = 300_000
"""Words a Python worker remembers of a tokenizer from slice to slice. Words beyond are encoded once in each slice."""

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_BETWEEN = "\x01"
_AT_ONCE = 2000


class WordEncoder:
    """A tokenizer that drops white space and case, so that words are encoded independently: each distinct word once.

    Marks behind a word that ends with a letter are a token sequence of their own, so they count as a word, and case is dropped, before distinct words are looked for. Unknown words are
    given to the library many at a time, with a mark between them that no word holds.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        self.known = _KNOWN.setdefault(zlib.crc32(file), {})
        self.between = self._encode([_BETWEEN])[0]
        if len(self.between) != 1 or self._encode([f"A. {_BETWEEN} Bc"])[0] != [i for x in self._encode(["a", ".", _BETWEEN, "bc"]) for i in x]:
            raise ValueError("this tokenizer does not encode words independently of case and white space")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, new: list[bytes]) -> dict[bytes, bytes]:
        found = {}
        plain = [w for w in new if b"\x01" not in w]
        for at in range(0, len(plain), _AT_ONCE):
            part = plain[at : at + _AT_ONCE]
            joined = "".join(f"{w.decode('utf-8', 'replace')} {_BETWEEN} " for w in part)
            ids = np.array(self._encode([joined])[0], np.uint32)
            ends = np.flatnonzero(ids == self.between[0])
            starts = np.concatenate(([0], ends[:-1] + 1))
            found.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))
        odd = [w for w in new if b"\x01" in w]
        found.update((w, np.array(ids, np.uint32).tobytes()) for w, ids in zip(odd, self._encode([w.decode("utf-8", "replace") for w in odd]), strict=True))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins."""
        data, offsets = buffers(filled(texts))
        data, begins, ends = self._units(data, *runs(~SPACES[data], offsets))
        codes, table = distinct(data, begins, ends)
        table = table.to_pylist()
        known = self.known
        is_word = np.bincount(codes, minlength=len(table)) > 0  # not what lies between words
        per_word = [known.get(w) if there else b"" for w, there in zip(table, is_word.tolist(), strict=True)]
        missing = [i for i, ids in enumerate(per_word) if ids is None]
        fresh = self._encode_words([table[i] for i in missing])
        for i in missing:
            per_word[i] = fresh[table[i]]
        if len(known) < MAX_KNOWN_WORDS:
            known.update(islice(fresh.items(), MAX_KNOWN_WORDS - len(known)))
        sizes = np.concatenate(([0], np.cumsum([len(b) >> 2 for b in per_word]))).astype(np.int64)
        flat, at = gather(np.frombuffer(b"".join(per_word), np.uint32), sizes, codes)
        return flat, at[np.searchsorted(begins, offsets)]

    @staticmethod
    def _units(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, and the words with the marks behind a letter cut off as words of their own."""
        low = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
        last = np.maximum.accumulate(np.where(_IS_MARK[low], np.int32(-1), np.arange(len(low), dtype=np.int32)))
        cut = last[ends - 1] + 1
        letter = (low[cut - 1] >= 97) & (low[cut - 1] <= 122)
        cut = np.where((cut > begins) & letter, cut, ends)
        # These may hold a special token, which case and marks are part of.
        at = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        word = np.searchsorted(begins, at, side="right") - 1
        for i in np.unique(word[at + 2 <= ends[word]]).tolist():
            low[begins[i] : ends[i]] = data[begins[i] : ends[i]]
            cut[i] = ends[i]
        split = cut < ends
        place = np.arange(len(begins)) + np.cumsum(split) - split
        unit_begins, unit_ends = (np.empty(len(begins) + int(split.sum()), np.int64) for _ in range(2))
        unit_begins[place], unit_ends[place] = begins, cut
        unit_begins[place[split] + 1], unit_ends[place[split] + 1] = cut[split], ends[split]
        return low, unit_begins, unit_ends


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Pieces of at most `capacity` ids: `(doc_id, piece, start, length, ids_crc32[, ids])`.

    A document is its ids and then `end_id`; null and empty texts are the end id alone. Only longer documents are cut, into pieces of
    exactly `capacity`; the last may be shorter. Repeated rows give repeated pieces. `ids_crc32` is that of the ids as little-endian
    unsigned 32-bit integers. Without `keep_ids` the ids stay in the task.
    """
    held = model_bytes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(held)
        for batch in slices(batches, text, 4_000_000):
            flat, bounds = encoder.encode(batch.column(text))
            row, piece, start, pieces = [], [], [], []
            for i in range(batch.num_rows):
                ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    pieces.append(ids[at : at + capacity])
            columns = [
                batch.column(doc_id).cast(pa.int64()).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array([len(p) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
            ]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.concatenate(pieces).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    schema = T.StructType(
        [
            T.StructField(doc_id, T.LongType()),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        ]
    )
    return map_arrow(docs.select(doc_id, text), run, schema)


class Slot(NamedTuple):
    """Ranks of one length that go into a row of sequences: `each` of them into every sequence, beginning at `offset`."""

    length: int
    first_rank: int
    each: int
    first_sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Best fit over counts, long lengths first. At most about three slots per distinct length."""
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []  # sorted keys of open_at
    slots: list[Slot] = []
    sequences = 0

    def keep(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            each = min(room // length, left)
            used = min(many, left // each)
            slots.append(Slot(length, rank, each, first, capacity - room))
            keep(room - each * length, first, used)
            keep(room, first + used, many - used)
            rank, left = rank + each * used, left - each * used
    return slots


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_slice: int = 200_000) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: gapless from 0 in each sequence, at most `capacity` in all.

    `pieces` has `doc_id, piece, start, length, ids_crc32` and is read several times, so it should be a stored table. Lengths run from
    1 to `capacity` (others are an error), so the histogram and the plan on the driver have a bound that does not depend on the data.
    A length that a third of all pieces share is ranked in slices of about `rows_per_slice` rows. No pieces give no rows.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(n is None or not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots = plan(histogram, capacity)
    spread = max(1, -(-sum(histogram.values()) // rows_per_slice))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    sliced = pieces.withColumn("_key", key).withColumn("_slice", F.pmod("_key", F.lit(spread)))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("length", "_slice")
        .agg(F.count("*").alias("_rows"))
        .select("length", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint")).alias("_before"))
    )
    inside = Window.partitionBy("length", "_slice").orderBy("_key", "doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_slice"])
        .withColumn("_rank", F.col("_before") + F.col("_inside"))
        .select(*pieces.columns, "_rank")
    )
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks of all lengths on one line, each length in a block of its own.
        block = np.int64(1) << np.int64(48)
        line = table[:, 0] * block + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            slot = table[np.searchsorted(line, length * block + rank, side="right") - 1]
            bin_of, turn = np.divmod(rank - slot[:, 1], slot[:, 2])
            columns = [batch.column(c) for c in pieces_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + bin_of), pa.array(slot[:, 4] + turn * length)], [*pieces_columns, "sequence_id", "offset"])

    pieces_columns = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_arrow(ranked, place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents tokenized, cut and packed: `(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id, doc_id, text, keep_ids=False).withColumnRenamed(doc_id, "doc_id")
    return pack(written(pieces, "pieces"), capacity).withColumnRenamed("doc_id", doc_id)
