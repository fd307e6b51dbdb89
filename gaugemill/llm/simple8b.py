"""Simple-8b: as many integers in a 64-bit word as their widths allow.

The upper four bits of a word, the selector, say how many values share its 60 lower bits; the first value
lies lowest. Values are coded in blocks that begin at a word of their own, so that a block can be decoded
without those before it, and all words of many blocks at once in numpy.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed values of the code: values in a word for each selector, and the bits that each takes. Selector 0 is
#: a run of zeros. Selector 1 is one half of an escaped value, of more than 60 bits: its upper 32 bits come first,
#: then its lower 32, so escapes always come in pairs.
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 32, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, RUN = 1, 240
_U = np.uint64


@cache
def _widths() -> np.ndarray:
    return np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each row, the selector of the word that begins there: of those whose values all fit, the one
    with the most. Places past the end of a row need no bits."""
    choice, known, size = np.full(bits.shape, ESCAPE, np.uint8), {1: bits}, 1
    while size * 2 <= RUN:
        known[size * 2] = np.maximum(known[size], np.pad(known[size][:, size:], ((0, 0), (0, size))))
        size *= 2
    for selector in range(len(COUNTS) - 1, -1, -1):  # the last that fits holds the most values
        if selector != ESCAPE:
            n = COUNTS[selector]
            p = 1 << (n.bit_length() - 1)
            fits = known[p] <= BITS[selector]
            if n > p:
                fits[:, : p - n] &= fits[:, n - p :]
            np.copyto(choice, selector, where=fits)
    return choice


def encode_blocks(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of ``block`` values, and how many words each block has. The last block may be shorter."""
    n_blocks, n = -(-len(values) // block), len(values)
    if not n_blocks:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    flat = np.zeros(n_blocks * block + RUN, _U)
    flat[:n] = values
    bits = _widths()[flat] if flat.max() < 1 << 16 else np.searchsorted(_U(1) << np.arange(64, dtype=_U), flat, "right").astype(np.uint8)
    choice = _selectors(np.pad(bits[: n_blocks * block].reshape(n_blocks, block), ((0, 0), (0, RUN))))[:, :block]
    # Where the word that begins at a place ends, in rows of their own: none reaches into the next block.
    ends = np.full((n_blocks, block + 1), block, np.int32)
    ends[:, :block] = np.array(COUNTS, np.int32)[choice] + np.arange(block, dtype=np.int32)
    np.minimum(ends, block, out=ends)
    ends[-1] = np.minimum(ends[-1], n - block * (n_blocks - 1))
    ends += (np.arange(n_blocks, dtype=np.int32) * (block + 1))[:, None]
    step, at, last, visited = ends.reshape(-1), np.arange(n_blocks) * (block + 1), ends.max(axis=1), []
    while (at < last).any():
        for _ in range(64):  # a word of every block
            visited.append(at)
            at = step[at]
    visited = np.stack(visited, axis=1)
    row = np.broadcast_to(np.arange(n_blocks)[:, None], visited.shape)
    live = visited < last[:, None]
    at, row = visited[live], row[live]
    place, length = at - row, step[at] - at
    selector = choice.reshape(-1)[place]
    double = 1 + (selector == ESCAPE)
    first = np.cumsum(double) - double
    words = np.zeros(int(double.sum()), _U)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        start = place[mine]
        if s == ESCAPE:
            words[first[mine]] = flat[start] >> _U(32)
            words[first[mine] + 1] = flat[start] & _U(0xFFFFFFFF) | _U(ESCAPE << 60)
        elif s:
            inside, room = np.arange(COUNTS[s]), length[mine]
            part = flat[start[:, None] + inside] << (inside * BITS[s]).astype(_U)
            if (room < COUNTS[s]).any():
                part[inside >= room[:, None]] = 0
            words[first[mine]] = np.bitwise_or.reduce(part, axis=1)
        words[first[mine]] |= _U(s << 60)
    return words, np.bincount(row, double, minlength=n_blocks).astype(np.int64)


def decode_blocks(words: np.ndarray, n_words: np.ndarray, n_values: np.ndarray) -> np.ndarray:
    """The values of blocks that follow each other, given the words and values of each."""
    selector = (words >> _U(60)).astype(np.int64)
    escaped = np.flatnonzero(selector == ESCAPE)
    count = np.array(COUNTS)[selector]
    count[escaped[1::2]] = 0  # both halves are one value
    # The last word of a block may have room for more than the block has.
    last = np.cumsum(n_words) - 1
    ends = np.cumsum(count)
    before = np.concatenate(([0], ends[last][:-1])) if len(last) else np.zeros(0, np.int64)
    over = ends[last] - before - n_values if len(last) else before
    if (over < 0).any():
        raise ValueError("a block has fewer values than it says")
    tail = last.copy()
    tail[count[tail] == 0] -= 1  # the pair's first half stands for it
    kept = count.copy()
    kept[tail] -= over
    if (kept < 0).any():
        raise ValueError("a block has more words than its values need")
    start = np.cumsum(kept) - kept
    out = np.zeros(int(kept.sum()), _U)
    for s in np.unique(selector).tolist():
        if s > ESCAPE:
            mine = np.flatnonzero(selector == s)
            inside = np.arange(COUNTS[s])
            value = (words[mine][:, None] >> (inside * BITS[s]).astype(_U)) & _U((1 << BITS[s]) - 1)
            live = inside < kept[mine][:, None]
            out[(start[mine][:, None] + inside)[live]] = value[live]
    high, low = escaped[::2], escaped[1::2]
    out[start[high]] = (words[high] << _U(32)) | (words[low] & _U(0xFFFFFFFF))
    return out
