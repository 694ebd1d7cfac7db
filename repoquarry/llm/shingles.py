"""Word shingles of texts and their ProbMinHash signatures, for many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from repoquarry.llm.texts import filled, mix, words


class Shingles(NamedTuple):
    hashes: np.ndarray
    """Distinct 64-bit hashes of each text, sorted within the text."""
    counts: np.ndarray
    offsets: np.ndarray


def shingles(texts: pa.Array, width: int = 5) -> Shingles:
    """`width` words in a row; a shorter text is one shingle, a text without words has none."""
    found = words(filled(texts))
    per_word = np.array([xxhash.xxh3_64_intdigest(t) for t in found.table.to_pylist()], np.uint64)
    lengths = np.diff(found.offsets)
    kept = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(lengths)), kept)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept)
    first = found.offsets[:-1][owner] + place
    hashes = np.zeros(len(owner), np.uint64)
    for k in range(width):
        inside = k < lengths[owner]
        at = np.minimum(first + k, max(0, len(found.codes) - 1))
        with np.errstate(over="ignore"):
            hashes = np.where(inside, mix(hashes * np.uint64(31) + per_word[found.codes[at]]) if len(owner) else hashes, hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return Shingles(hashes[at], counts, np.searchsorted(owner[at], np.arange(len(lengths) + 1)))


def signatures(found: Shingles, size: int) -> np.ndarray:
    """ProbMinHash: equal places of two rows have the probability Jaccard similarity of the weighted shingles as their share.

    Every shingle sends points of a Poisson process, of a rate that is its weight, to the places in an order of its own, each place
    once. A place takes the shingle whose point comes first. Points come in time order, so a shingle stops as soon as its next point is
    later than the last place of its text was taken. `size` is a prime number. Texts without shingles have zeros.
    """
    n = len(found.offsets) - 1
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(found.offsets))
    hashes, weight = found.hashes, found.counts.astype(float)
    begin = (mix(hashes + np.uint64(1)) % np.uint64(size)).astype(np.int64)
    step = (mix(hashes + np.uint64(2)) % np.uint64(size - 1)).astype(np.int64) + 1
    time = np.zeros(len(hashes))
    with np.errstate(over="ignore"):
        for turn in range(size):
            noise = mix(hashes + np.uint64(turn + 3) * np.uint64(0x9E3779B97F4A7C15))
            uniform = (noise >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
            time = time - np.log(uniform) / (weight * (size - turn))
            place = owner * size + (begin + turn * step) % size
            np.minimum.at(first, place, time)
            won = first[place] == time
            winner[place[won]] = hashes[won]
            last = first.reshape(n, size).max(1)
            going = time < last[owner]
            if not going.any():
                break
            hashes, weight, owner, begin, step, time = (a[going] for a in (hashes, weight, owner, begin, step, time))
    return winner.reshape(n, size)
