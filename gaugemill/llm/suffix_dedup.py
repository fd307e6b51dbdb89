"""Substring dedup by bytes: suffix arrays per shard, Kasai common prefixes, binary-search merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .recurring import WINDOW, _pick, byte_units, merged, repeated_windows
from .textops import span_hashes

GRAM_BYTES = 20
#: A suffix array is built over so many bytes; a shard has several blocks.
BLOCK_BYTES = 512 << 10
LANE = 64
#: A number is of as many bytes as there are entries not above it.
_BYTES = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _eight(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there as one big-endian number; zeros beyond the end."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    return key


def suffix_array(data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes, then by place, by Larsson-Sadakane refinement.

    The first order is by eight bytes at once. A suffix's rank is the first place of its group, so
    sorting by the rank ``h`` bytes further on doubles the sorted depth; only groups with more than
    one member are sorted again.
    """
    n = len(data)
    key = _eight(data)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[:n]
    bits = max(1, int(n).bit_length())
    packs = 3 * bits <= 64
    place = np.arange(n)
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = 8
    while h < depth:
        step = min(h, depth - h)
        alone = new & np.concatenate((new[1:], [True]))[:n]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        suffix = order[at]
        further = suffix + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        if packs:  # group, rank further on and place in one number
            packed = ((group[at] << bits | second).astype(np.uint64) << np.uint64(bits)) | suffix.astype(np.uint64)
            packed.sort()
            order[at], pair = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
        else:
            pair = group[at] * (n + 1) + second
            sort = np.lexsort((suffix, pair))
            order[at], pair = suffix[sort], pair[sort]
        new[at] = np.concatenate(([True], pair[1:] != pair[:-1]))
        group = np.maximum.accumulate(np.where(new, place, 0))
        rank[order] = group
        h += step
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Length, up to ``most``, of the prefix that each suffix shares with the one before it in ``order``.

    Kasai's scan: a suffix shares at least one byte less than the suffix that starts one byte
    earlier. That rests on the order of the differing byte; where the earlier pair agrees in all
    ``most`` sorted bytes, it is used only if the neighbour too has moved on by one byte. Many
    stretches of ``LANE`` suffixes are scanned side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = _eight(data)
    lanes = np.arange(0, n, LANE)
    have, out = np.zeros(len(lanes), np.int64), np.zeros(n, np.int64)
    for t in range(min(LANE, n)):
        live = np.flatnonzero(lanes + t < n)
        i = lanes[live] + t
        j = before[i]
        sure = (have[live] < most) | (j == before[np.maximum(i - 1, 0)] + 1)
        h = np.where((j >= 0) & sure, np.maximum(have[live] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        end = np.minimum(most, n - np.maximum(i, j))
        while len(go):
            x, y = i[go] + h[go], j[go] + h[go]
            differ = key[np.minimum(x, n - 1)] ^ key[np.minimum(y, n - 1)]
            same = 8 - np.searchsorted(_BYTES, differ, "right")
            h[go] = np.minimum(h[go] + same, end[go])
            go = go[(same == 8) & (h[go] < end[go])]
        have[live] = h
        out[i] = h
    return out[order]


def _block_groups(data: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each window start and a window start for each group, in suffix order."""
    order = suffix_array(data)
    run = np.cumsum(common_prefixes(data, order) < WINDOW) - 1
    place = np.empty(len(data), np.int64)
    place[order] = run
    at = place[windows]
    held = np.zeros(len(data), bool)
    held[at] = True
    number = np.cumsum(held) - 1
    group = number[at]
    rep = np.zeros(int(held.sum()), np.int64)
    rep[group] = windows
    return group, rep


def suffix_groups(data: np.ndarray, lengths: np.ndarray, anchors: np.ndarray):
    """Windows of one shard: (snippet, offset, group of equal windows). The shard is cut into blocks with
    a suffix array each; a block's distinct windows, in suffix order, are merged into those of the
    blocks before by binary search. With ``anchors``, snippets whose gram at that place no other snippet
    here has are left out: a window always comes with the same gram."""
    numbers = np.arange(len(lengths))
    if anchors is not None and len(lengths):
        at = np.cumsum(lengths) - lengths
        _, gram, n = np.unique(span_hashes(data, at + anchors, at + anchors + GRAM_BYTES), return_inverse=True, return_counts=True)
        numbers = np.flatnonzero(n[gram] > 1)
        data, lengths = data[_pick(at[numbers], lengths[numbers])], lengths[numbers]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    snippets, places, groups = [], [], []
    known = np.zeros(0, f"S{WINDOW}")
    names = np.zeros(0, np.int64)
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        own = np.repeat(np.arange(i, j), lengths[i:j] - WINDOW + 1)
        first = np.concatenate(([0], np.cumsum(lengths[i:j] - WINDOW + 1)))[:-1]
        offset = np.arange(len(own)) - first[own - i]
        block = data[offsets[i] : offsets[j]]
        group, rep = _block_groups(block, offsets[own] + offset - offsets[i])
        text = np.lib.stride_tricks.sliding_window_view(block, WINDOW)[rep].tobytes()
        mine = np.frombuffer(text, f"S{WINDOW}")
        at = np.searchsorted(known, mine)
        there = at < len(known)
        there[there] = known[at[there]] == mine[there]
        name = np.empty(len(mine), np.int64)
        name[there] = names[at[there]]
        name[~there] = len(known) + np.arange(int((~there).sum()))
        if j < len(lengths):
            merged_ = np.concatenate((known, mine[~there]))
            order = np.argsort(merged_, kind="stable")
            known, names = merged_[order], np.concatenate((names, name[~there]))[order]
        snippets.append(numbers[own])
        places.append(offset)
        groups.append(name[group])
        i = j
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (snippets, places, groups))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row: the UTF-8 bytes that no repeated string of
    50 bytes covers. A string is repeated if it also starts in a document with a smaller id.

    A cut may fall inside a character, so ``kept`` is binary. Null texts are empty; texts under 50
    bytes lose nothing. See ``recurring`` for null and repeated ids. Windows are compared byte by byte.
    An empty table gives an empty result.
    """
    texts, decisions = repeated_windows(docs, byte_units, GRAM_BYTES, suffix_groups, 1 / 15, b"", id_col, text_col)

    def apply(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = []
            for packed, whole, spans in zip(*(batch.column(c) for c in ("packed", "whole", "spans")), strict=True):
                raw = unpack.decompress(packed.as_py())
                n = len(raw)
                cut = np.array([[0, n]] if n >= WINDOW else []).reshape(-1, 2) if whole.as_py() else merged(spans.as_py() or [])
                edges = [0, *cut.reshape(-1).astype(int).tolist(), n]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((n, n - len(kept), len(cut), kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(decisions, ["doc_id", "mark"], "left").select("doc_id", "packed", "whole", "spans").mapInArrow(apply, _OUT)


def op9_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
