from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repoquarry.llm import packing, queries, sentence_pieces, token_counts

from .conftest import ODD

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_the_library(odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentence_pieces.encode_pieces(odd, MODEL).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_bos=True, add_eos=True)
        assert row.n_lines == "kept"
    back = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(odd, MODEL), MODEL, text="again").collect()
    assert all(r.again == library.decode(r.ids) for r in back)
    assert sentence_pieces.encode_pieces(empty, MODEL).collect() == []
    counted = sentence_pieces.piece_counts(odd, MODEL).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(len(r.ids) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" a▁b\n\tÉ日<0>. ́"), max_size=12), min_size=1, max_size=5))
def test_chunks_of_any_text(texts):
    import pyarrow as pa

    encoder = sentence_pieces.ChunkEncoder(sentence_pieces.model_bytes(MODEL))
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == encoder.library.encode(texts, add_bos=True, add_eos=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" aAb.'s!\n\tÉß1<|>\x01 ́-"), max_size=14), min_size=1, max_size=5))
def test_words_of_any_text(texts):
    import pyarrow as pa

    encoder = packing.WordEncoder(sentence_pieces.model_bytes(WORDS))
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_remembered_without_case_and_marks():
    encoder = packing.WordEncoder(sentence_pieces.model_bytes(WORDS))
    encoder.known = {}
    texts = ["Quark, QUARK, quark! quark", "<|Quark, <|Quark,", None]
    flat, bounds = encoder.encode(pa.array(texts))
    assert set(encoder.known) == {b"quark", b",", b"!", b"<|Quark,"}
    whole = Tokenizer.from_str(sentence_pieces.model_bytes(WORDS).decode())
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_op1_on_a_table(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = []
    for i, text in ODD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        expected.append((i, len(ids), *digests))
    assert sorted(map(str, map(tuple, queries.op1_sentence_pieces(spark, str(tmp_path)).collect()))) == sorted(map(str, expected))
    rows = queries.op2_token_counts(spark, str(tmp_path)).collect()
    lengths = [e[1] for e in expected]
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.docs_longer == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.n_tokens)
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths)
        assert r.tokens_cut == sum(lengths) - r.tokens_truncated
        assert r.doc_share == pytest.approx(sum(n <= r.n_tokens for n in lengths) / len(lengths))


def test_counts_by_group_limit_and_quantile(spark):
    data = [("a", 3), ("a", 3), ("a", 10), ("b", None), ("b", 4)]
    totals = token_counts.context_totals(token_counts.length_histogram(spark.createDataFrame(data, "g string, n_tokens int"), by=["g"]), by=["g"])
    limits = {(r.g, r.context): (r.tokens_truncated, r.docs_cut) for r in token_counts.at_limit(totals, [2, 5, 100], ["g"]).collect()}
    assert limits["a", 2] == (6, 3) and limits["a", 5] == (11, 1) and limits["a", 100] == (16, 0) and limits["b", 2] == (2, 1)
    found = {(r.g, r.share): r.n_tokens for r in token_counts.quantiles(totals, [0.5, 0.9], ["g"]).collect()}
    assert found == {("a", 0.5): 3, ("a", 0.9): 10, ("b", 0.5): 0, ("b", 0.9): 4}
    none = token_counts.length_histogram(spark.createDataFrame([], "n_tokens int"))
    assert token_counts.context_totals(none).collect() == []


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        ends = [0, *np.cumsum([n for _, n in own]).tolist()]
        assert [o for o, _ in own] == ends[:-1] and ends[-1] <= capacity
    return len(places)


def test_packing_is_whole_and_gapless(spark, odd, empty):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(odd, WORDS, capacity=64).collect()
    sequences = check_packing(rows, 64)
    expected = []
    for i, text in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            expected.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(str, expected))
    assert sequences <= -(-sum(e[3] for e in expected) // 64) + 2
    assert packing.pack_documents(empty, WORDS).collect() == []


def test_packing_of_one_hot_length(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 7L else 1 + id % 16 end as length", "id as ids_crc32")
    rows = packing.pack(pieces, capacity=16, rows_per_slice=50).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 16) <= -(-sum(r.length for r in rows) // 16) + 70


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=32))
def test_plan(counts):
    slots = packing.plan(counts, 32)
    assert len(slots) <= 3 * len(counts) + 3
    filled = {}
    for length, many in counts.items():
        own = sorted(s for s in slots if s.length == length)
        assert not own or own[0].first_rank == 0
        for k, slot in enumerate(own):
            for rank in range(slot.first_rank, own[k + 1].first_rank if k + 1 < len(own) else many):
                bin_of, turn = divmod(rank - slot.first_rank, slot.each)
                filled.setdefault(slot.first_sequence + bin_of, []).append((slot.offset + turn * length, length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][0] + own[-1][1] <= 32 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert sum(map(len, filled.values())) == sum(counts.values())
