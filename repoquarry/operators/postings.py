"""Postings of documents on their way to blocks, in compressed pieces.

Those of a million words are sent to the parts of the index as pieces that hold what postings share (paths, terms) once and numbers as steps, so
they do not take the disk that rows with a path each would.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE = 1 << 40
"""What the number of a block in a slice of a large term begins with, times the number of the slice."""

_U = np.uint64
_PRIMES = [_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxhash64(texts: pa.Array, seed: int = 42) -> np.ndarray:
    """Spark's `xxhash64` of texts without nulls, as unsigned numbers; texts of one length are hashed at once."""
    one, two, three, four, five = _PRIMES
    data = texts.cast(pa.binary())
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False)
    hashes = np.zeros(len(data), _U)
    with np.errstate(over="ignore"):
        mixed = lambda lane: _turned(lane * two, 31) * one
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            letters = np.frombuffer(b"".join(data.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), size)
            lanes = lambda begin, n, kind: np.ascontiguousarray(letters[:, begin : begin + n]).view(kind)[:, 0].astype(_U)
            done = 0
            if size >= 32:
                start = np.array([seed], _U)
                four_sums = [np.repeat(x, len(at)) for x in (start + one + two, start + two, start, start - one)]
                for done in range(0, size - 31, 32):
                    four_sums = [_turned(v + lanes(done + 8 * i, 8, "<u8") * two, 31) * one for i, v in enumerate(four_sums)]
                done += 32
                h = sum((_turned(v, n) for v, n in zip(four_sums, (1, 7, 12, 18))), np.zeros(len(at), _U))
                for v in four_sums:
                    h = (h ^ mixed(v)) * one + four
            else:
                h = np.full(len(at), _U(seed)) + five
            h = h + _U(size)
            while done + 8 <= size:
                h, done = _turned(h ^ mixed(lanes(done, 8, "<u8")), 27) * one + four, done + 8
            if done + 4 <= size:
                h, done = _turned(h ^ (lanes(done, 4, "<u4") * one), 23) * two + three, done + 4
            while done < size:
                h, done = _turned(h ^ (lanes(done, 1, "u1") * five), 11) * one, done + 1
            h = (h ^ (h >> _U(33))) * two
            h = (h ^ (h >> _U(29))) * three
            hashes[at] = h ^ (h >> _U(32))
    return hashes


def _cut(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> list[pa.RecordBatch]:
    """Rows of a batch one after the other, in parts of about a size."""
    if not batch.num_rows:
        return []
    begun = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False)) // most
    begins = np.flatnonzero(np.diff(begun, prepend=-1)).tolist()
    return [batch.slice(a, b - a) for a, b in zip(begins, [*begins[1:], batch.num_rows])]


def _steps(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences of neighbours; groups begin with their first value."""
    steps = np.diff(values, prepend=values[:1])
    steps[begins] = values[begins]
    return steps


def _sums(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What `_steps` took."""
    sums = np.cumsum(steps, dtype=np.int64)
    sums -= np.repeat(sums[begins] - steps[begins], np.diff(np.append(begins, len(steps))))
    return sums.astype(np.int32)


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. in each group."""
    return np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(_begins(sizes).astype(np.int32), sizes)


def give_back() -> None:
    """Returns memory to the machine: workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _written(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 on, each compressed as the planes of its bytes."""
    head, packed = [], []
    for c in columns:
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        wide = c.astype("<u4" if width <= 4 else "<u8")
        packed.append(pa.compress(wide.view(np.uint8).reshape(len(c), -1)[:, :width].T.tobytes(), codec="zstd", asbytes=True) if len(c) else b"")
        head += [len(c), width, len(packed[-1])]
    return np.array(head, "<i4").tobytes() + b"".join(packed)


def _read(piece: bytes, columns: int) -> list[np.ndarray]:
    at, found = 12 * columns, []
    for n, width, size in np.frombuffer(piece, "<i4", 3 * columns).reshape(-1, 3).tolist():
        wide = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
        if n:
            raw = pa.decompress(piece[at : at + size], n * width, codec="zstd", asbytes=True)
            wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        found.append(wide.reshape(-1).view("<u4" if width <= 4 else "<u8"))
        at += size
    return found


def _text_columns(texts: pa.StringArray) -> list[np.ndarray]:
    """Sizes and letters of texts without nulls."""
    if not len(texts):
        return [np.zeros(0, np.int32), np.zeros(0, np.uint8)]
    _, offsets, letters = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return [np.diff(ends), np.frombuffer(letters, np.uint8)[ends[0] : ends[-1]] if letters else np.zeros(0, np.uint8)]


def _texts(sizes: np.ndarray, letters: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(letters.astype(np.uint8)))


def _slices(hot: dict, repos: list, terms: pa.Array, paths: list, repo: np.ndarray, term: np.ndarray, tf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The slice of each posting of a large term, from 1 on, and 0 for all others. Postings lie by term."""
    found = np.zeros(len(term), np.int32)
    if not hot:
        return found
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    nulls = sum(p is None for p in paths)
    for (of_repo, of_term), cuts in hot.items():
        if of_term not in number or of_repo not in repos:
            continue
        a, b = np.searchsorted(term, [number[of_term], number[of_term] + 1])
        own = a + np.flatnonzero(repo[a:b] == repos.index(of_repo))
        found[own] = 1
        for least, path in cuts:
            from_here = 0 if path is None else bisect_left(paths, path, nulls)
            found[own] += (tf[own] < least) | ((tf[own] == least) & (place[own] >= from_here))
    return found


def _inverted(held: list[pa.RecordBatch], parts: int, buckets: int, hot: dict) -> pa.RecordBatch:
    """Pieces `(part, piece)` of documents `(repo_id, path, words)`."""
    table = pa.Table.from_batches(held)
    held.clear()
    # Documents count in the order of their paths.
    by_path = pc.sort_indices(table.select(["path"]), sort_keys=[("path", "ascending")], null_placement="at_start")
    paths = table.column("path").combine_chunks().take(by_path)
    rank = np.empty(table.num_rows, np.int64)
    rank[by_path.to_numpy()] = np.arange(table.num_rows)
    coded_repos = table.column("repo_id").combine_chunks().dictionary_encode()
    repos, repo_of = coded_repos.dictionary.to_pylist(), coded_repos.indices.take(by_path).to_numpy()
    words = table.column("words").combine_chunks()
    del table
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    del words
    by_term, many = pc.sort_indices(coded.dictionary), len(paths)
    terms = coded.dictionary.take(by_term)

    # Words by term, document and place.
    name = np.argsort(by_term.to_numpy())[coded.indices.to_numpy()] * many
    name += np.repeat(rank, sizes)
    del coded
    order = np.argsort(name, kind="stable")
    name = name[order]
    at = _inside(sizes)[order]
    del order
    begins = np.flatnonzero(np.diff(name, prepend=-1)).astype(np.int32)
    tf = np.diff(np.append(begins, np.int32(len(name))))
    term, place = (x.astype(np.int32) for x in np.divmod(name[begins], many))
    del name
    repo = repo_of[place]

    slices = _slices(hot, repos, terms, paths.to_pylist() if hot else [], repo, term, tf, place)
    hashes = xxhash64(terms)
    bucket = (hashes.view(np.int64) % buckets).astype(np.int32)
    if parts <= buckets:
        part = (bucket * parts // buckets)[term]
    else:
        among = parts // buckets
        of_repos, of_terms = (((x >> _U(32)) % _U(among)).astype(np.int32) for x in (xxhash64(pa.array([str(r) for r in repos], pa.string())), hashes))
        part = (bucket * among)[term] + (of_terms[term] + of_repos[repo]) % among
    # Slices of a term are merged apart.
    part = (part + np.maximum(slices - 1, 0)) % parts

    # Postings by part, term, repository and slice, each in the order of its documents.
    order = np.lexsort((-tf, slices, repo, term, part))
    part, term, repo, slices, tf, place, first = (x[order] for x in (part, term, repo, slices, tf, place, begins))
    positions = _steps(at[np.repeat(first, tf) + _inside(tf)], _begins(tf))
    del order, at, begins, first
    changes = lambda *xs: np.flatnonzero(np.any([np.diff(x, prepend=-1) != 0 for x in xs], axis=0))
    runs = changes(part, term, repo, slices)
    ends = np.append(changes(part), len(part)).tolist()
    letters = terms.take(pa.array(term[runs]))
    word_at = np.append(0, np.cumsum(tf))
    rows: list[tuple[int, bytes]] = []
    for a, b in zip(ends, ends[1:]):
        first_run, last_run = np.searchsorted(runs, [a, b])
        run_at = runs[first_run:last_run]
        used = np.zeros(many, bool)
        used[place[a:b]] = True
        local = (np.cumsum(used) - 1)[place[a:b]]
        level = np.diff(tf[a:b], prepend=-1) != 0
        level[run_at - a] = True
        held = paths.take(pa.array(np.flatnonzero(used)))
        columns = [
            np.array([held.null_count]), *_text_columns(held.drop_null()), *_text_columns(letters.slice(first_run, last_run - first_run)),
            repo[run_at], slices[run_at], np.diff(np.append(run_at, b)), tf[a:b], _steps(local, np.flatnonzero(level)), positions[word_at[a] : word_at[b]],
        ]
        here = sorted(set(repo[run_at].tolist()))
        columns[5] = np.searchsorted(here, repo[run_at])
        rows.append((int(part[a]), pickle.dumps(([repos[i] for i in here], _written(columns)))))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "piece"])


def inverted(words: DataFrame, parts: int, buckets: int, hot: dict, words_at_once: int) -> DataFrame:
    """`(part, piece)`: postings of `words(repo_id, path, words)`, by the part of the buckets of `xxhash64` of their terms.

    `hot` has the cuts `(tf, path)` at which the documents of large terms `(repo_id, term)` are sliced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for part in _cut(batch, batch.column("words").value_lengths(), words_at_once):
                held.append(part)
                n += len(part.column("words").flatten())
                if n >= words_at_once:
                    yield _inverted(held, parts, buckets, hot)
                    n = 0
            batch = part = None
            give_back()
        if n:
            yield _inverted(held, parts, buckets, hot)
        give_back()

    return words.mapInArrow(run, "part int, piece binary")


def _merged(pieces: list[bytes], kind: pa.DataType, block: int, rows_at_once: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a part, some postings at once."""
    opened = [pickle.loads(p) for p in pieces]
    pieces.clear()
    repos = [pa.array(r, kind) for r, _ in opened]
    read = [_read(data, 11) for _, data in opened]
    del opened
    paths = pa.concat_arrays([x for c in read for x in (pa.nulls(int(c[0][0]), pa.string()), _texts(c[1], c[2]))])
    terms = pa.concat_arrays([_texts(c[3], c[4]) for c in read])
    path_base, repo_base = (_begins(np.array(n)) for n in ([int(c[0][0]) + len(c[1]) for c in read], [len(r) for r in repos]))
    gathered = lambda i: np.concatenate([c[i] for c in read]).astype(np.int32)
    run_repo = np.concatenate([c[5].astype(np.int64) + b for c, b in zip(read, repo_base)])
    run_slice, run_size, tf, steps, position_steps = (gathered(i) for i in (6, 7, 8, 9, 10))
    counts = [len(c[8]) for c in read]
    del read

    # Paths by their steps, in the groups of documents of one frequency.
    run = np.repeat(np.arange(len(run_size), dtype=np.int32), run_size)
    level = np.diff(tf, prepend=-1) != 0
    level[_begins(run_size)] = True
    path = _sums(steps, np.flatnonzero(level)) + np.repeat(path_base.astype(np.int32), counts)
    positions = _sums(position_steps, _begins(tf))
    del steps, position_steps, level

    coded_terms, coded_repos = terms.dictionary_encode(), pa.concat_arrays(repos).dictionary_encode()
    ranked = lambda values: np.argsort(pc.sort_indices(values, null_placement="at_start").to_numpy()).astype(np.int32)
    term = ranked(coded_terms.dictionary)[coded_terms.indices.to_numpy()][run]
    repo = coded_repos.indices.to_numpy()[run_repo][run]
    piece_of = run_slice[run]
    order = np.lexsort((ranked(paths)[path], -tf, piece_of, repo, term))
    start = _begins(tf)[order]
    run, repo, term, piece_of, tf, path = (x[order] for x in (run, repo, term, piece_of, tf, path))
    new = np.any([np.diff(x, prepend=-1) != 0 for x in (term, repo, piece_of)], axis=0)
    own = np.flatnonzero(new)
    sizes = np.diff(np.append(own, len(tf)))
    blocks = -(-sizes // block)
    number = np.arange(int(blocks.sum())) - np.repeat(_begins(blocks), blocks)
    begins = np.repeat(own, blocks) + number * block
    number += piece_of[begins].astype(np.int64) * SLICE
    ends = np.append(begins[1:], len(tf))
    stops = [*np.flatnonzero(np.diff(begins // rows_at_once, prepend=-1)).tolist(), len(begins)]
    for a, b in zip(stops, stops[1:]):
        low, high = int(begins[a]), int(ends[b - 1])
        few = tf[low:high]
        index = np.repeat(start[low:high], few) + _inside(few)
        lists = pa.array(np.append(begins[a:b], high) - low, pa.int32())
        held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(few)), pa.int32()), pa.array(positions[index]))
        first = run[begins[a:b]]
        columns = [
            coded_repos.dictionary.take(pa.array(repo[begins[a:b]])), terms.take(pa.array(first)), pa.array(number[a:b], pa.int64()),
            pa.array(ends[a:b] - begins[a:b], pa.int64()), pa.array(tf[begins[a:b]], pa.int64()),
            pa.ListArray.from_arrays(lists, paths.take(pa.array(path[low:high]))), pa.ListArray.from_arrays(lists, pa.array(few, pa.int32())), pa.ListArray.from_arrays(lists, held),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["repo_id", "term", "block", "docs", "max_tf", "paths", "tfs", "positions"])


def merged(pieces: DataFrame, parts: int, repo: T.StructField, block: int, rows_at_once: int) -> DataFrame:
    """Blocks `(repo_id, term, block, docs, max_tf, paths, tfs, positions)` of the postings of each part, which one task holds."""

    kind = to_arrow_type(repo.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [piece for batch in batches for piece in batch.column("piece").to_pylist()]
        if held:
            yield from _merged(held, kind, block, rows_at_once)
        give_back()

    schema = T.StructType([T.StructField("repo_id", repo.dataType), *T.StructType.fromDDL("term string, block long, docs long, max_tf long, paths array<string>, tfs array<int>, positions array<array<int>>").fields])
    return pieces.repartitionById(parts, "part").mapInArrow(run, schema)
