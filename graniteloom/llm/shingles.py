"""Sets of hashed word shingles, computed for whole slices of texts at once.

Words are the runs [^ \\t-\\r]+ of the lower-cased (A-Z) text. All of a slice's bytes are hashed together: a word's
hash comes from prefix sums of a polynomial modulo 2^64, a shingle's from the mixed hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 1 << 21
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = np.uint64(1)
    return np.multiply.accumulate(out)


_BYTE = mixed(np.arange(256, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(17))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_INVERSE = pow(int(BASE), -1, 1 << 64)


def sets_of(raw: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; text i is raw[ends[i - 1] : ends[i]].

    A text with fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    if len(ends) == 0:
        return []
    # A space after every text keeps words apart.
    raw = np.insert(raw, ends, np.uint8(32)) if len(raw) else np.full(len(ends), 32, dtype=np.uint8)
    ends = ends + np.arange(1, len(ends) + 1)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _powers(len(raw), int(BASE)), dtype=np.uint64)])
    h = (sums[end] - sums[begin]) * _powers(len(raw) + 1, _INVERSE)[begin]
    h = mixed(h + (end - begin).astype(np.uint64) * STEP)
    text = np.searchsorted(ends, begin, side="right")
    counts = np.bincount(text, minlength=len(ends))
    first = np.concatenate([[0], np.cumsum(counts)])
    whole = np.zeros(0, dtype=np.uint64)
    if len(h) >= words:
        n = len(h) - words + 1
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            whole = whole * STEP + h[j : j + n]
        whole = mixed(whole)
    out = []
    for i in range(len(ends)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = x * BASE + v
            out.append(mixed(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes) of each text of an Arrow string array, slice by slice; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lengths = np.asarray(pa.compute.binary_length(texts), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + lengths[end] <= SLICE_BYTES):
            total += lengths[end]
            end += 1
        part = texts.slice(begin, end - begin)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        yield from zip(range(begin, end), sets_of(raw, offsets[1:] - offsets[0], words), strict=True)
        begin = end


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers."""
    with np.errstate(over="ignore"):
        both = np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s)), mixed(s + STEP).sum(dtype=np.uint64)], dtype=np.uint64)
    a, b = mixed(both).view(np.int64)
    return int(a), int(b)
