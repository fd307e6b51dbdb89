"""Words and hashes of many texts at once, in numpy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .mph import mixed

SLICE_BYTES = 1 << 19
_U = np.uint64


@cache
def _byte_table(lower: bool) -> np.ndarray:
    """A fixed odd 64-bit value for each byte; with ``lower`` A-Z have those of a-z."""
    t = mixed(np.arange(1, 257, dtype=_U), 77) | _U(1)
    if lower:
        t[65:91] = t[97:123]
    return t


_known_powers = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2^64; the longest are kept."""
    if len(_known_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(n, _U(b))
            p[0] = 1
            _known_powers[k] = np.cumprod(p, dtype=_U, out=p)
    return _known_powers[0][:n], _known_powers[1][:n]


@cache
def _is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them with one more than rows) of runs of rows of about
    ``limit`` bytes; a null is empty. A longer text makes a run of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, whole[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that are not ASCII white space."""
    solid = ~_is_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from one running sum."""
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_table(lower)[data] * power[: len(data)], out=total[1:], dtype=_U)
    return mixed((total[ends] - total[starts]) * inverse[starts], 5)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes: len(h) - k + 1 values (none if negative)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    power, inverse = _powers(1 << max(16, int(len(h)).bit_length()))
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * power[: len(h)], out=total[1:], dtype=_U)
    return mixed((total[k:] - total[:n]) * inverse[:n], 9)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``k`` words of each text, and the text of each, sorted by text and
    hash. A text with fewer words has its whole sequence as one; a text without words has none."""
    starts, ends, text = words(data, offsets)
    h = span_hashes(data, starts, ends, lower)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    long = run_hashes(h, k)
    fits = text[: len(long)] == text[k - 1 :] if len(long) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    power, inverse = _powers(1 << max(16, int(len(h)).bit_length()))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[: len(h)], dtype=_U)))
    first = np.concatenate(([0], np.cumsum(count)))[short]
    whole = mixed((total[first + count[short]] - total[first]) * inverse[first] + count[short].astype(_U), 13)
    out, owner = np.concatenate((long[fits], whole)), np.concatenate((text[: len(long)][fits], short))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new]
