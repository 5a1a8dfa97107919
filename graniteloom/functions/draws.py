"""Multiplicities of a bootstrap: Poisson(1) draws from the MD5 of "seed:replicate:unit", for many units at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Draws worked out at a time: fewer pay for calls, more leave the caches.
BLOCK = 32768
# The distribution function of the Poisson distribution of mean 1, as the least 32-bit number that reaches it.
STEPS = [math.ceil(c * 2**32) for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)]
# The start, the shifts and the sines of MD5 (RFC 1321).
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Bytes of a message that fit a block beside its length.
ROOM = 55


def first_words(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of n messages of one block each: 16 arrays of little-endian words, None for zeros."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif turn == 1:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        f += a
        f += SINES[i]
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        if word is not None:
            f += word
        by = SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=g)
        np.bitwise_or(np.left_shift(f, np.uint32(by), out=f), g, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(START[0])).byteswap()


def multiplicities(units: list[str | None], replicates: int, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(reps, w): blocks of replicates (from 1 on) with a row of multiplicities, one a unit, for each. A null unit leaves
    its part of the message out; units too long for a block are hashed one by one."""
    tails = [b"" if u is None else b":" + u.encode() for u in units]
    n, sizes = len(tails), np.array([len(t) for t in tails], np.int64)
    for digits in range(1, len(str(replicates)) + 1):
        reps = np.arange(10 ** (digits - 1), min(10**digits - 1, replicates) + 1)
        head = len(f"{seed}:") + digits
        long = np.flatnonzero(sizes + head > ROOM)
        block = np.zeros((n, 64), np.uint8)
        for i, tail in enumerate(tails):
            if sizes[i] + head <= ROOM:
                block[i, head : head + len(tail) + 1] = np.frombuffer(tail + b"\x80", np.uint8)
        block[:, 56:58] = (8 * (sizes + head)).astype("<u2").view(np.uint8).reshape(n, 2)
        ends = np.ascontiguousarray(block.view("<u4").T)
        step = max(1, BLOCK // n)
        for at in range(0, len(reps), step):
            some = reps[at : at + step]
            begin = np.zeros((len(some), 64), np.uint8)
            begin[:, :head] = [list(f"{seed}:{r}".encode()) for r in some]
            begin = begin.view("<u4")
            words = [(begin[:, k, None] | ends[k]).ravel() if begin[:, k].any() or ends[k].any() else None for k in range(16)]
            drawn = first_words(words, len(some) * n).reshape(len(some), n)
            for i in long:
                drawn[:, i] = [int(hashlib.md5(f"{seed}:{r}".encode() + tails[i]).hexdigest()[:8], 16) for r in some]
            w = np.zeros(drawn.shape, np.uint8)
            for s in STEPS:
                w += drawn >= s
            yield some, w
