"""Simple-8b: whole numbers packed word by word, as many to a 64-bit word as its widest allows.

The top four bits of a word are its selector. Selectors 1 to 14 pack COUNTS[s] numbers of BITS[s] bits, the first in the lowest bits;
15 is a run of 120 zeros; 0 is an escape: one number of more than 60 bits, which stands in the block's list of escapes at the place
that the word's low bits give. Numbers go in blocks of a fixed size, and no word crosses a block. A block's last word may have room
beyond its block; what it holds there is dropped. So a block is decoded from its offset and length alone, all words at once.
"""

from __future__ import annotations

import numpy as np

#: Numbers in a word, and bits of each, by selector (fixed values of the format).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, ZEROS, WIDEST = 0, 15, 60
BLOCK = 1024
#: Blocks that are packed at once.
MANY = 512


def widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    # frexp is exact below 2^53, so halves of 32 bits give the length
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def selectors(width: np.ndarray) -> np.ndarray:
    """For each place of some blocks (rows), the selector of the most numbers from there that fit one word."""
    blocks, length = width.shape
    best = np.zeros((blocks, length), np.uint8)
    reach = {1: width}  # widest of the next 2^j numbers; what is beyond the block has no width
    step = 1
    while step < 64:
        wide = reach[step].copy()
        wide[:, : length - step] = np.maximum(wide[:, : length - step], reach[step][:, step:])
        step *= 2
        reach[step] = wide
    order = sorted(range(1, 16), key=lambda s: COUNTS[s])
    for s in order:  # the last that fits holds the most
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        wide = reach[p]
        if n > p and n - p < length:
            wide = wide.copy()
            wide[:, : length - (n - p)] = np.maximum(wide[:, : length - (n - p)], reach[p][:, n - p :])
        best[wide <= BITS[s]] = s
    return best


def pack(numbers: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes, first escape of each block) of unsigned 64-bit numbers."""
    numbers = np.ascontiguousarray(numbers, np.uint64)
    parts = [_pack(numbers[a : a + block * MANY], block) for a in range(0, len(numbers), block * MANY)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = lambda k: np.concatenate([p[k] + before for p, before in zip(parts, np.cumsum([0] + [len(p[k - 1]) for p in parts]).tolist(), strict=False)])
    return np.concatenate([p[0] for p in parts]), at(1), np.concatenate([p[2] for p in parts]), at(3)


def _pack(numbers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    blocks = -(-len(numbers) // block)
    x = np.zeros((blocks, block + int(COUNTS.max())), np.uint64)  # room for what the last word may reach
    own = np.full(blocks, block, np.int64)
    own[-1] = len(numbers) - (blocks - 1) * block
    x[:, :block][np.arange(block) < own[:, None]] = numbers
    chosen = selectors(widths(x[:, :block].ravel()).reshape(blocks, block))
    # all blocks take their next word together; marks of where words begin leave them in order
    wide = x.shape[1]
    at, begins = np.arange(blocks) * wide, np.zeros(x.size, bool)
    stop, step = at + own, np.zeros((blocks, wide), np.uint8)
    step[:, :block] = COUNTS[chosen]
    step = step.ravel()
    while len(at):
        begins[at] = True
        at = at + step[at]
        on = at < stop
        at, stop = at[on], stop[on]
    flat, begins = x.ravel(), np.flatnonzero(begins)
    row = begins // wide
    chosen = chosen.ravel()[begins - row * (wide - block)].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, ZEROS):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            n, bits, from_ = int(COUNTS[s]), int(BITS[s]), begins[mine]
            packed = flat[from_]
            for j in range(1, n):
                packed |= flat[from_ + j] << np.uint64(j * bits)
            words[mine] |= packed
    large = np.flatnonzero(chosen == ESCAPE)
    first = np.searchsorted(row[large], np.arange(blocks))
    words[large] = (np.arange(len(large)) - first[row[large]]).astype(np.uint64)
    return words, np.searchsorted(row, np.arange(blocks)), flat[begins[large]], first


def unpack(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, first: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """The numbers of consecutive blocks, of which all but the last are full; starts and first as pack gives them."""
    out = np.zeros(total, np.uint64)
    if not total:
        return out
    chosen = (words >> np.uint64(60)).astype(np.int64)
    n = COUNTS[chosen]
    ends = np.cumsum(n)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    before = ends - n
    place = before - before[starts][of] + of * block  # where a word's first number goes
    stop = np.minimum((of + 1) * block, total)
    for s in range(1, ZEROS):
        mine = np.flatnonzero(chosen == s)
        bits, low = int(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            to = place[mine] + j
            inside = to < stop[mine]
            if not inside.all():
                mine, to = mine[inside], to[inside]
            out[to] = (words[mine] >> np.uint64(j * bits)) & low
    large = np.flatnonzero(chosen == ESCAPE)
    if len(large):
        out[place[large]] = escapes[first[of[large]] + (words[large] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out
