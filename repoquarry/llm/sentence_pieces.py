"""SentencePiece encoding and decoding with a table of distinct chunks.

In the models this is for, a piece holds white-space markers at its start only, so pieces never cross from one marked
word (markers and the characters up to the next marker) to the next. Each distinct marked word of a slice of texts is
segmented once by the library and its ids are joined back by position. The table lives in the task: a table of all chunks
of a corpus grows with the corpus and would have to be shuffled with every word occurrence.

Texts that begin with a space or hold the marker character itself go to the library whole, since their chunks depend on
their neighbours. Null is the empty text. A model whose pieces cross markers, or that normalises texts, is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repoquarry.llm.texts import buffers, distinct, filled, gather, slices

_MARK = "▁"
_PROBE = " å Å ﬁ Ａ　​  x "


class ChunkEncoder:
    """One model in one task."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        if any(_MARK in piece.lstrip(_MARK) for piece in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        if self.library.normalize(_PROBE) != _MARK + _PROBE.replace(" ", _MARK):
            raise ValueError("this model normalises texts or adds no leading marker")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, with begin and end ids, and where each text begins."""
        texts = filled(texts)
        whole = {}
        for i, text in enumerate(texts.to_pylist()):
            if text.startswith(b" ") or _MARK.encode() in text:
                whole[i] = np.array(self.library.encode(text.decode("utf-8", "replace")), np.int32)
        data, offsets = buffers(texts)
        space = data == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        for i in whole:
            starts[offsets[i] : offsets[i + 1]] = False
        begins = np.flatnonzero(starts)
        chunk_of = np.searchsorted(begins, offsets)
        ends = np.append(begins[1:], len(data))
        for i in whole:  # bytes of such a text belong to no chunk
            if chunk_of[i]:
                ends[chunk_of[i] - 1] = min(ends[chunk_of[i] - 1], offsets[i])
        codes, table = distinct(data, begins, ends)
        chunks = [c.decode("utf-8", "replace") for c in table.to_pylist()]
        # The library adds the leading marker itself, but not to an empty text.
        segmented = self.library.encode([c.removeprefix(" ") for c in chunks], num_threads=1)
        if " " in chunks:
            segmented[chunks.index(" ")] = [self.library.piece_to_id(_MARK)]
        sizes = np.concatenate(([0], np.cumsum([len(s) for s in segmented]))).astype(np.int64)
        flat = np.fromiter((i for s in segmented for i in s), np.int32, sizes[-1])
        ids, at = gather(flat, sizes, codes)
        bounds = at[chunk_of]
        first, last = np.array([self.library.bos_id()], np.int32), np.array([self.library.eos_id()], np.int32)
        parts = []
        for i in range(len(texts)):
            parts += [first, whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]], last]
        lengths = [sum(map(len, parts[3 * i : 3 * i + 3])) for i in range(len(texts))]
        return np.concatenate(parts) if parts else flat[:0], np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver and sent with the tasks; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column set; it goes last, and columns of that name in any case are left out."""
    kept = [c for c in batch.schema.names if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, name])


def encoded(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        found, offsets = encoder.encode(batch.column(text))
        yield put(batch, ids, pa.ListArray.from_arrays(offsets.astype(np.int32), found))


def decoded(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(ids)
        texts = [encoder.library.decode(i.values.drop_null().to_pylist()) if i.is_valid else None for i in lists]
        yield put(batch, text, pa.array(texts, pa.string()))


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of `docs` and the ids of each text (`array<int>`), with begin and end ids.

    Every row has a result: null and empty texts have the begin and the end id only. Repeated rows stay repeated. A column
    named like `ids` is replaced, all others are kept as they are.
    """
    held = model_bytes(model)
    return docs.mapInArrow(lambda batches: encoded(batches, ChunkEncoder(held), text, ids), _schema(docs, ids, T.ArrayType(T.IntegerType())))


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of `df` and the text of each id list, as the library decodes it. Null lists give null, null ids none."""
    held = model_bytes(model)
    return df.mapInArrow(lambda batches: decoded(batches, ChunkEncoder(held), ids, text), _schema(df, text, T.StringType()))


def _digests(batches: Iterator[pa.RecordBatch], doc_id: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(doc_id).cast(pa.int64()),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
            ],
            [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text per row: encoding and decoding in one pass."""
    held = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(held)
        return _digests(decoded(encoded(batches, encoder, text, "ids"), encoder, "ids", "decoded"), doc_id)

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def piece_counts(docs: DataFrame, model: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """All columns of `docs` and the number of ids of each text; the ids themselves stay in the task."""
    held = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoded(batches, ChunkEncoder(held), text, n_tokens):
            yield put(batch, n_tokens, pa.array(np.diff(batch.column(n_tokens).offsets.to_numpy()).astype(np.int64)))

    return docs.mapInArrow(run, _schema(docs, n_tokens, T.LongType()))
