"""Leading bits of the MD5 digests of many texts at once, in numpy.

The texts differ in a few prefixes and share their tails: a row is packed into words once for each length of a prefix,
and each prefix then changes the first words only. A step of the digest is one pass over LANES rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

LANES = 1 << 14  # rows of one pass, so that its arrays stay in a core's cache
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: int, blocks: int) -> np.ndarray:
    """(16 x blocks, rows): the padded words of the texts behind ``skip`` bytes of prefix, which are zero."""
    out = np.zeros((len(sizes), 64 * blocks), np.uint8)
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    out[row, skip + inside] = data[np.repeat(starts, sizes) + inside]
    out[np.arange(len(sizes)), skip + sizes] = 0x80
    out[:, -8:] = ((skip + sizes) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out.view("<u4").T)


def _added(words: np.ndarray) -> list:
    """What each of the 64 steps adds: a number where its word is zero in all rows, else one for each row."""
    some = words.any(1)
    return [words[WORD[i]] + np.uint32(SINES[i]) if some[WORD[i]] else np.uint32(SINES[i]) for i in range(64)]


def _block(state: list, added: list) -> list:
    """``state`` after one block of 64 steps."""
    a, b, c, d = (s.copy() for s in state)
    f, r = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, added[i], out=f)
        np.left_shift(f, np.uint32(SHIFTS[i]), out=r)
        np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=f)
        np.bitwise_or(f, r, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, y, out=x) for x, y in zip((a, b, c, d), state)]


def _states(prefixes: list[bytes], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, list]]:
    """(number of a prefix, rows, four words of the digests) of each prefix with each tail, in passes."""
    for length in sorted({len(p) for p in prefixes}):
        need = (length + sizes + 72) // 64
        for blocks in map(int, np.unique(need)):
            wanted = np.flatnonzero(need == blocks)
            for at in range(0, len(wanted), LANES):
                rows = wanted[at : at + LANES]
                words = _packed(data, starts[rows], sizes[rows], length, blocks)
                plain = [_added(words[16 * k : 16 * k + 16]) for k in range(blocks)]
                for number, prefix in enumerate(prefixes):
                    if len(prefix) != length:
                        continue
                    front = np.frombuffer(prefix.ljust(-(-length // 4) * 4, b"\0"), "<u4")
                    state = [np.full(len(rows), s, np.uint32) for s in START]
                    for k in range(blocks):
                        mixed = {j: words[16 * k + j] | w for j, w in enumerate(front[16 * k : 16 * k + 16])}
                        added = [mixed[WORD[i]] + np.uint32(SINES[i]) if WORD[i] in mixed else x for i, x in enumerate(plain[k])]
                        state = _block(state, added)
                    yield number, rows, state


def md5_heads(prefixes: list[bytes], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a prefix, rows, heads): the first 32 bits of the digests of each prefix with each tail, in passes.

    Tail ``n`` is ``data[starts[n] : starts[n] + sizes[n]]``. Heads order as the first eight hex digits do. The rows of
    a pass rise.
    """
    for number, rows, state in _states(prefixes, data, starts, sizes):
        yield number, rows, state[0].byteswap()


def md5_order(prefixes: list[bytes], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(prefixes, rows): the tails in the order of their digests behind each prefix; equal digests stay in their order."""
    halves = np.empty((2, len(prefixes), len(sizes)), np.uint64)
    for number, rows, state in _states(prefixes, data, starts, sizes):
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in state)
        halves[0, number, rows], halves[1, number, rows] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return np.stack([np.lexsort((low, high)) for high, low in zip(*halves)])
