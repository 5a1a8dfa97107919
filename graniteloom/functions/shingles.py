"""Sets of hashed token shingles, worked out by numpy for whole slices of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together, one text at least.
SLICE_BYTES = 1 << 21
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(17))


@lru_cache(maxsize=2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^log2 powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        powers = np.full(1 << log2, np.uint64(base), dtype=np.uint64)
        powers[0] = np.uint64(1)
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def sets_of(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and how many each has.

    Text i is raw[ends[i - 1] : ends[i]]; a space ends each of its tokens, the last one too. A text of fewer than k tokens
    has all of them as its one shingle.
    """
    stop = np.flatnonzero(raw == 32)
    begin = np.concatenate([[0], stop[:-1] + 1])
    powers, inverse = _powers(max(21, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers[: len(raw)], dtype=np.uint64)])
    h = mixed((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64) * STEP)
    last = np.searchsorted(stop, ends)  # tokens up to the end of each text
    first = np.concatenate([[0], last[:-1]])
    n = last - first
    h = np.concatenate([h, np.zeros(k, np.uint64)])
    some, whole = np.zeros(len(n), np.uint64), np.ones(len(stop), np.uint64)
    for m in range(k):
        whole = whole * STEP + h[m : m + len(stop)]
        short = n == m + 1
        some[short] = whole[first[short]]
    counts = np.maximum(n - k + 1, 1)
    upto = np.cumsum(counts)
    found = whole[np.repeat(first - (upto - counts), counts) + np.arange(upto[-1])]
    found[(upto - counts)[n < k]] = some[n < k]
    found = mixed(found).view(np.int64)
    for a, b in zip(upto - counts, upto, strict=True):
        found[a:b].sort()
    fresh = np.concatenate([[True], found[1:] != found[:-1]])
    fresh[upto - counts] = True
    return found[fresh], np.add.reduceat(fresh.astype(np.int64), upto - counts)


_WHITE = np.isin(np.arange(256), [9, 10, 13, 32])


def single_spaced(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts, each ended by white space, with one space after each token and none else; one alone for a text without tokens."""
    white = _WHITE[raw]
    starts = np.concatenate([[0], ends[:-1]])
    after = np.concatenate([[True], white[:-1]])
    after[starts] = True
    keep = ~(white & after)
    upto = np.cumsum(keep)
    bare = upto[ends - 1] == upto[starts] - keep[starts]
    if bare.any():
        keep[ends[bare] - 1] = True
        upto = np.cumsum(keep)
    return np.where(white, np.uint8(32), raw)[keep], upto[ends - 1]


def sets_by_slice(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, shingles, sizes) of slices of an Array of texts, each ended by white space."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, side="right")) - 1)
        yield begin, end, *sets_of(*single_spaced(data[offsets[begin] : offsets[end]], offsets[begin + 1 : end + 1] - offsets[begin]), k)
        begin = end


def key_of(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    at = np.cumsum(sizes) - sizes
    x = found.view(np.uint64)
    return tuple(mixed(np.add.reduceat(v, at)).view(np.int64) for v in (mixed(x), mixed(x + STEP) * BASE))


def firsts(found: np.ndarray, sizes: np.ndarray, most: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each set the first `most` shingles in the order of their hashes, those in `last` (sorted) after all others."""
    late = np.zeros(len(found), bool) if len(last) == 0 else last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    text = np.repeat(np.arange(len(sizes)), sizes)
    ordered = found[np.argsort(text * 2 + late, kind="stable")] if late.any() else found
    at = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ordered[at < np.repeat(most, sizes)]


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))
