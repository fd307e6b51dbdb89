"""Finding every window of 50 words or bytes that also starts in a document with a smaller id.

Both substring operators share this frame; they differ in the unit and in how a shard is resolved.

1. In each window the k-gram with the smallest hash is its minimizer: equal windows have equal ones, and
   neighbouring windows mostly share theirs, so few k-grams stand for all windows. Their hashes are
   dealt over buckets, which tell those that occur in two different texts. Of equal texts only the one
   with the smallest id goes on; all windows of the others start in it.
2. Texts are joined with what recurs in them. Around each recurring minimizer the windows that it
   stands for are cut out as one snippet and sent to the shard of that minimizer, so all occurrences
   of a window meet in one shard and no window is in two. Snippets that are equal inside a task are
   resolved there and move once.
3. A shard finds equal windows; those of a document that is not the smallest come back as spans.
4. Texts are joined with their spans.

Texts travel compressed. Nulls: a null text is empty; a row with a null id neither loses anything nor
makes others lose; rows that repeat an id do not count as smaller than each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, settle, settle_table
from .mph import mixed
from .ngram_join import _NULL_ID, SHARED, bucket_count, emit, shared_hashes, token_names
from .textops import SLICE_BYTES, _byte_table, _powers, run_hashes, slices, span_hashes, words

WINDOW = 50
SNIPPET_TASK_BYTES = 6 << 20
#: Bytes of a mark that travel with an id: they need only tell apart the texts of a repeated id.
MARK = 8
SHARD_BYTES = 4 << 20
_U = np.uint64
_STATUS = "doc_id long, mark binary, size long, tokens binary"
_SNIPPETS = "shard int, docs binary, marks binary, starts binary, counts binary, lengths binary, anchors binary, data binary"
SPANS = "doc_id long, mark binary, spans binary"


def word_units(data: np.ndarray, offsets: np.ndarray):
    """Hash, text, first and end byte of each word."""
    starts, ends, text = words(data, offsets)
    return span_hashes(data, starts, ends), text, starts, ends


def byte_units(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data))
    return _byte_table(False)[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), at, at + 1


def text_marks(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """128 bits for the sequence of units of each text."""
    power, inverse = _powers(1 << max(16, int(len(h)).bit_length()))
    end = np.cumsum(count)
    start = end - count
    out = np.zeros((len(count), 2), _U)
    for c, x in enumerate((h, mixed(h, 3))):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(x * power[: len(x)], dtype=_U)))
        out[:, c] = mixed((total[end] - total[start]) * inverse[start] + count.astype(_U), 51 + c)
    return out


def minimizers(h: np.ndarray, text: np.ndarray, k: int, window: int = WINDOW):
    """(k-gram hash, position, first and last window start) of each run of windows with one minimizer.
    Ties go to the leftmost, which depends on the window alone."""
    n, width = len(h), window - k + 1
    if n < window:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    g = run_hashes(h, k)
    bits = _U(max(22, int(n).bit_length()))
    low, done = ((g >> bits) << bits) | np.arange(len(g), dtype=_U), 1
    while done * 2 <= width:
        low, done = np.minimum(low[:-done], low[done:]), done * 2
    if done < width:
        low = np.minimum(low[: n - window + 1], low[width - done : width - done + n - window + 1])
    starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    at = (low[starts] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.concatenate((edge[1:], [len(at)]))[: len(edge)] - 1
    return g[at[edge]], at[edge], starts[edge], starts[last]


def anchor_measure(units, k: int):
    """For ``emit``: distinct minimizer hashes of each text, its number of units, its mark."""

    def measure(data, offsets):
        h, text, _, _ = units(data, offsets)
        count = np.bincount(text, minlength=len(offsets) - 1)
        g, at, _, _ = minimizers(h, text, k)
        owner = text[at]
        order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        return g[new], owner[new], count, text_marks(h, count)

    return measure


def _status(t):
    """Per document of a chunk: mark, size, and the names of its recurring minimizers."""
    bucket = t["bucket"].to_pylist()
    info = bucket.index(min(bucket))
    ids, size = np.frombuffer(t["docs"][info].as_py(), "<i8"), np.frombuffer(t["rarity"][info].as_py(), "<u4").astype(np.int64)
    marks = np.frombuffer(t["tokens"][info].as_py(), "<u8").reshape(-1, 2)
    rest = [i for i in range(len(bucket)) if i != info]
    doc = np.concatenate([np.frombuffer(t["docs"][i].as_py(), "<u4") for i in rest] or [np.zeros(0, "<u4")])
    token = np.concatenate([token_names(np.frombuffer(t["tokens"][i].as_py(), "<u8"), bucket[i]) for i in rest] or [np.zeros(0, _U)])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    return pa.table({
        "doc_id": pa.array([None if x == _NULL_ID else x for x in ids.tolist()], pa.int64()), "mark": pa.array([m.tobytes() for m in marks], pa.binary()), "size": pa.array(size),
        "tokens": pa.array([token[edge[d] : edge[d + 1]].tobytes() if edge[d] < edge[d + 1] else None for d in range(len(ids))], pa.binary()),
    })


def packed_texts(rows: DataFrame, units) -> DataFrame:
    """(doc_id, mark, packed): every text with the first bytes of the mark that status rows bear."""

    def run(batches):
        import zstandard

        zstd = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                h, text, _, _ = units(data, offsets)
                marks = text_marks(h, np.bincount(text, minlength=j - i))
                raw = data.tobytes()
                packed = [zstd.compress(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([m.tobytes()[:MARK] for m in marks], pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "mark", "packed"])

    return rows.mapInArrow(run, "doc_id long, mark binary, packed binary")


def _pick(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ..., start + length - 1 of each pair, one after another."""
    kind = np.int32 if not len(start) or max(int((start + length).max()), int(length.sum())) < 1 << 31 else np.int64
    out = np.repeat((start - np.concatenate(([0], np.cumsum(length)[:-1]))).astype(kind), length)
    out += np.arange(len(out), dtype=kind)
    return out


def equal_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray, *before: np.ndarray, then: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """An order of the snippets data[start : start + length] in which equal ones (with equal ``before``)
    stand together, inside a run by ``then``, and whether each begins a run. Hashes bring equal snippets
    together; neighbours of one hash are held against each other byte by byte."""
    h = span_hashes(data, start, start + length)
    order = np.lexsort((*then[::-1], h, length, *before[::-1]))
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (h, length, *before):
        same &= x[order[1:]] == x[order[:-1]]
    at = np.flatnonzero(same)
    end = np.cumsum(length[order[at]])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + SLICE_BYTES, "right")))
        n = length[order[at[i:j]]]
        differ = data[_pick(start[order[at[i:j]]], n)] != data[_pick(start[order[at[i:j] + 1]], n)]
        same[at[i:j]] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        i = j
    new[1:] = ~same
    return order, new


def _flat(data: np.ndarray, begin: np.ndarray, end: np.ndarray, separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units that stand side by side, with ``separator`` between them: bytes, first and end byte of each."""
    if not separator:
        return data, begin, end
    n = end - begin
    first = np.cumsum(n + 1) - n - 1
    out = np.full(int(n.sum()) + len(n), separator[0], np.uint8)
    out[_pick(first, n)] = data[_pick(begin, n)]
    return out, first, first + n


def _cut(units, k: int, buckets: int, shards: int, separator: bytes):
    """(doc_id, mark, packed, tokens) to snippets by shard; snippets equal inside the task move once."""
    step = _U(0x9E3779B97F4A7C15)

    def run(batches):
        import zstandard

        unpack, zstd = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        held: list[tuple] = []
        rows: list[tuple] = []
        size, waiting = 0, 0

        def found():
            """The snippets of the texts that wait: token, doc, mark, first unit, units, anchor, bytes."""
            nonlocal rows, waiting
            data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
            wanted = np.frombuffer(b"".join(r[3] for r in rows), "<u8") + np.repeat(np.arange(len(rows), dtype=_U), [len(r[3]) // 8 for r in rows]) * step
            h, text, begin, end = units(data, offsets)
            g, at, a, b = minimizers(h, text, k)
            doc = text[at]
            bucket, h40 = g % _U(buckets), (g // _U(buckets)) & _U((1 << 40) - 1)
            name = mixed(h40 | (bucket << _U(40)), 31)
            hit = np.flatnonzero(np.isin(name + doc.astype(_U) * step, wanted))
            at, a, b, doc = at[hit], a[hit], b[hit], doc[hit]
            flat, first, last = _flat(data, begin, end, separator)
            low = first[a]
            length = last[b + WINDOW - 1] - low
            ids, marks = np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), "<u8")
            out = (name[hit], ids[doc], marks[doc], a - np.searchsorted(text, doc), b - a + WINDOW, at - a, length, flat[_pick(low, length)])
            rows, waiting = [], 0
            return out

        def flush():
            """The smallest id of equal snippets is sent; the others lose all their windows here and now."""
            nonlocal held, size
            token, doc, mark, start, count, anchor, length, data = map(np.concatenate, zip(*held, strict=True))
            held, size = [], 0
            begin = np.cumsum(length) - length
            order, new = equal_runs(data, begin, length, token, then=(doc, start))
            least = doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
            lost = np.zeros(len(order), bool)
            lost[order] = doc[order] > least
            out = []
            pack = lambda x, kind: zstd.compress(x.astype(kind).tobytes())
            if lost.any():
                out.append((-1, pack(doc[lost], "<i8"), mark[lost].tobytes(), pack(start[lost], "<u4"), pack(count[lost], "<u4"), b"", b"", b""))
            shard = (token % _U(shards)).astype(np.int64)
            order = order[~lost[order]]
            order = order[np.argsort(shard[order], kind="stable")]
            edge = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
            for i, j in zip(edge, edge[1:], strict=False):
                x = order[i:j]
                if len(x):
                    out.append((int(shard[x[0]]), pack(doc[x], "<i8"), mark[x].tobytes(), pack(start[x], "<u4"), pack(count[x], "<u4"), pack(length[x], "<u4"), pack(anchor[x], "<u4"), zstd.compress(data[_pick(begin[x], length[x])].tobytes())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int32(), *[pa.binary()] * 7)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SNIPPETS.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "packed", "tokens")), strict=True):
                raw = unpack.decompress(row[2])
                rows.append((row[0], row[1], raw, row[3]))
                waiting += len(raw)
                if waiting >= SLICE_BYTES:
                    held.append(found())
                    size += len(held[-1][-1]) + 50 * len(held[-1][0])
                    if size >= SNIPPET_TASK_BYTES:
                        yield flush()
        if rows:
            held.append(found())
        if held:
            yield flush()

    return run


def lost_runs(docs: np.ndarray, snippet: np.ndarray, offset: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From windows (snippet number, offset in it, number of its group of equal windows) those whose group
    has a smaller document, as (snippet, first unit, end unit) of runs of windows."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[snippet])
    lost = docs[snippet] > least[group]
    snippet, at = snippet[lost], offset[lost].astype(np.int64)
    order = np.lexsort((at, snippet))
    snippet, at = snippet[order], at[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (snippet[1:] != snippet[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.concatenate((edge[1:], [len(at)]))[: len(edge)] - 1
    return snippet[edge], at[edge], at[last] + WINDOW


def spans_table(docs: np.ndarray, marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """One row per document and mark with its (begin, end) pairs, sorted and disjoint."""
    order = np.lexsort((begin, marks, docs))
    docs, marks, begin, end = docs[order], marks[order], begin[order], end[order]
    first = np.concatenate((np.ones(min(1, len(docs)), bool), (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])))
    own = (np.cumsum(first) - 1) << 33  # texts one after another on one line
    high = np.maximum.accumulate(end + own)
    edge = np.flatnonzero(np.concatenate((first[:1], (begin + own)[1:] > high[:-1])))
    pairs = np.stack([begin[edge], (high - own)[np.concatenate((edge[1:], [len(docs)]))[: len(edge)] - 1]], axis=1).astype("<u4")
    at = np.flatnonzero(first[edge])
    cuts = [*at.tolist(), len(edge)]
    return pa.table({
        "doc_id": pa.array(docs[edge[at]], pa.int64()), "mark": pa.array([m.tobytes() for m in marks[edge[at]].astype("<u8")], pa.binary()),
        "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
    })


def _resolve(resolve):
    def run(key, t):
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def column(name, kind):
            return np.concatenate([np.frombuffer(unpack.decompress(x), kind) for x in t[name].to_pylist()]).astype(np.int64)

        docs, starts, counts = column("docs", "<i8"), column("starts", "<u4"), column("counts", "<u4")
        marks = np.frombuffer(b"".join(t["marks"].to_pylist()), "<u8")
        if key[0].as_py() < 0:
            return spans_table(docs, marks, starts, starts + counts)
        lengths, anchors = column("lengths", "<u4"), column("anchors", "<u4")
        data = np.frombuffer(b"".join(unpack.decompress(x) for x in t["data"].to_pylist()), np.uint8)
        # Distinct snippets alone are compared. Of the occurrences of one, those in a document that is
        # not its smallest lose all their windows, the rest what the smallest loses.
        begin = np.cumsum(lengths) - lengths
        order, new = equal_runs(data, begin, lengths, then=(docs,))
        rep, of = order[new], np.cumsum(new) - 1
        more = docs[order] > docs[rep][of]
        all_ = order[more]
        s, lo, hi = lost_runs(docs[rep], *resolve(data[_pick(begin[rep], lengths[rep])], lengths[rep], anchors[rep]))
        same, own = order[~more], of[~more]
        first = np.searchsorted(own, s)
        n = np.searchsorted(own, s, "right") - first
        who = same[_pick(first, n)]
        lo, hi = np.repeat(lo, n), np.repeat(hi, n)
        who, lo, hi = np.concatenate((all_, who)), np.concatenate((np.zeros(len(all_), np.int64), lo)), np.concatenate((counts[all_], hi))
        return spans_table(docs[who], marks[who], starts[who] + lo, starts[who] + hi)

    return run


def repeated_windows(docs: DataFrame, units, k: int, resolve, per_byte: float, separator: bytes, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts packed, decisions): decisions are ``doc_id, mark, whole, spans`` - ``whole`` for texts equal
    to one with a smaller id, ``spans`` the covered units as concatenated (begin, end) pairs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(rows, per_byte)
    shared = emit(rows, anchor_measure(units, k), buckets).groupBy("bucket").applyInArrow(shared_hashes, SHARED)
    status = settle_table(settle_table(shared, "anchors", "lz4").groupBy("chunk").applyInArrow(_status, _STATUS), "status", "lz4").where("doc_id IS NOT NULL")
    first = settle(status.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    total = status.count()
    short = F.substring("mark", 1, MARK).alias("mark")
    live = status.where("tokens IS NOT NULL").join(first.select("mark", F.col("first").alias("doc_id")), ["mark", "doc_id"], "left_semi").groupBy("doc_id", short).agg(F.first("tokens").alias("tokens"))
    # The snippets hold a few bytes for each that recurs: as many shards as keep one at SHARD_BYTES.
    anchors = live.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
    shards = max(64, int(anchors * WINDOW * 1.4 * (6 if separator else 1) / SHARD_BYTES))
    texts = packed_texts(rows, units)
    work = texts.join(live, ["doc_id", "mark"]).select("doc_id", "mark", "packed", "tokens")
    snippets = work.mapInArrow(_cut(units, k, buckets, shards, separator), _SNIPPETS)
    salted = F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("docs"), F.lit(256))).otherwise(F.col("shard")).cast("int")
    spans = settle(snippets.withColumn("shard", salted).groupBy("shard").applyInArrow(_resolve(resolve), SPANS))
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("spans"))
    whole = join_groups(status.select("doc_id", "mark"), first.where("copies > 1"), "mark", "copies", total).where("doc_id > first").distinct().select("doc_id", short, F.lit(True).alias("whole"), F.lit(None).cast("array<binary>").alias("spans"))
    return texts, spans.select("doc_id", "mark", F.lit(False).alias("whole"), "spans").unionByName(whole)


def merged(spans: list[bytes]) -> np.ndarray:
    """Disjoint sorted (begin, end) pairs that cover the same."""
    x = np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2) for s in spans]).astype(np.int64) if spans else np.zeros((0, 2), np.int64)
    if not len(x):
        return x
    x = x[np.argsort(x[:, 0], kind="stable")]
    high = np.maximum.accumulate(x[:, 1])
    edge = np.flatnonzero(np.concatenate(([True], x[1:, 0] > high[:-1])))
    return np.stack([x[edge, 0], high[np.concatenate((edge[1:], [len(x)])) - 1]], axis=1)
