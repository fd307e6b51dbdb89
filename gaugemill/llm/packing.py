"""Lexical retrieval packing: BM25 neighbours fill the window of each seed document."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, settle, settle_table, table
from .mph import mixed
from .sharding import balanced_shards

K1, B = 1.2, 0.75
#: The one special token of the vocabulary; its string in a text is that token.
SPECIAL = {"<|endoftext|>": 50_256}
SIGNATURE = 4
#: Times that documents are dealt to shards, each by other draws. Before the last time windows take only
#: neighbours that score at least ``NEAR`` of what the seed scores for itself.
TURNS, NEAR = 2, 1 / 3
_TOKENS = "item long, doc_id long, doc_tokens long, digest long, packed binary, terms binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FILLED = "item long, start long, length long, seq long, offset long, have binary"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str, pattern: str):
    """Byte-pair ranks as a function from a text to an array of ids. It gives the ids that the tokenizers file of the same
    vocabulary gives by default, several times faster."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: enc.encode_to_numpy(text, allowed_special="all")


def tokenised(docs: DataFrame, path: str, pattern: str, end_id: int = 1, vocab_size: int = 50_257, window: int = 2048) -> DataFrame:
    """Ids of every whole text with ``end_id`` after them, as compressed 16-bit arrays, with the
    distinct ids and how often each occurs, written to the shared folder. ``item`` numbers the rows and
    leaves a number for each full window of a row; ``digest`` stands for the sequence of ids. Each
    task adds one row without id and with ``doc_tokens`` = -1, which holds how many of its documents
    contain each token: ``vocab_size`` numbers, whatever the input."""
    if vocab_size > 1 << 16:
        raise ValueError("ids are kept in 16 bits")

    def run(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        zstd, encode, df = zstandard.ZstdCompressor(level=1), encoder(path, pattern), np.zeros(vocab_size, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        record = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _TOKENS.split(", ")])
        held, size = [], 0

        def flush():
            nonlocal item, held, size
            count = np.array([len(x) for _, x in held])
            # One sort gives the distinct ids of all these documents.
            pair = (np.repeat(np.arange(len(held), dtype=np.uint32), count) << np.uint32(16)) | np.concatenate([x for _, x in held])
            pair.sort()
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            n, pair = np.minimum(np.diff(np.concatenate((first, [len(pair)]))), 65535).astype("<u2"), pair[first]
            term = (pair & np.uint32(65535)).astype("<u2")
            edge = np.searchsorted(pair, np.arange(len(held) + 1, dtype=np.uint64) << np.uint64(16)).tolist()
            np.add(df, np.bincount(term, minlength=vocab_size), out=df)
            rows = []
            for (doc_id, ids), a, b in zip(held, edge, edge[1:], strict=False):
                raw = ids.tobytes()
                rows.append((item, doc_id, len(ids), xxhash.xxh64_intdigest(raw) - (1 << 63), zstd.compress(raw), zstd.compress(term[a:b].tobytes() + n[a:b].tobytes())))
                item += 1 + len(ids) // window
            held, size = [], 0
            return record(list(zip(*rows, strict=True)))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u2")))
                size += len(held[-1][1])
                if size >= 1 << 20 or len(held) == 1 << 15:
                    yield flush()
        if held:
            yield flush()
        yield record([[None], [None], [-1], [None], [zstd.compress(df.astype("<i8").tobytes())], [b""]])

    return settle_table(docs.mapInArrow(run, _TOKENS), "tokens", "uncompressed")


def token_counts(tokens: DataFrame, vocab_size: int = 50_257) -> np.ndarray:
    """Document frequency of each token over all documents: at most ``vocab_size`` rows reach the driver."""

    def nonzero(batches):
        import zstandard

        for batch in batches:
            total = np.zeros(vocab_size, np.int64)
            for x in batch.column(0):
                total += np.frombuffer(zstandard.decompress(x.as_py()), "<i8")
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    rows = tokens.where("doc_tokens = -1").select("packed").mapInArrow(nonzero, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocab_size, np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def inverse_frequencies(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The classic idf ln((N - df + 0.5) / (df + 0.5)); a term in half of all documents or more tells
    none apart and has 0."""
    return np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0)


def unpacked_terms(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of all documents one after another, how often each occurs, and how many each document has."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(x), "<u2").reshape(2, -1) for x in packed]
    both = np.concatenate(rows, axis=1).astype(np.int64) if rows else np.zeros((2, 0), np.int64)
    return both[0], both[1], np.array([r.shape[1] for r in rows], np.int64)


def signatures(term: np.ndarray, n: np.ndarray, count: np.ndarray, idf: np.ndarray, turn: int = 0) -> np.ndarray:
    """A number for each document by which alike documents sort together: the terms that win
    ``SIGNATURE`` draws in turn. In a draw every term of the vocabulary has one exponential number,
    and the least one over weight wins, so a term wins in proportion to its weight and two documents
    agree in a draw about as often as their weights overlap. The weight is idf squared by a
    saturating count: rare terms decide. Each ``turn`` has draws of its own."""
    weight = idf[term] ** 2 * n / (n + K1)
    key, owner = np.zeros(len(count), np.uint64), np.repeat(np.arange(len(count)), count)
    live = weight > 0
    term, weight, owner = term[live], weight[live], owner[live]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1])))
    for draw in range(SIGNATURE):
        u = (mixed(np.arange(len(idf), dtype=np.uint64), 91 + SIGNATURE * turn + draw) >> np.uint64(11)).astype(float) / 2.0**53
        x = -np.log1p(-u)[term] / weight
        if len(first):
            least = np.minimum.reduceat(x, first)
            won = np.flatnonzero(x == np.repeat(least, np.diff(np.concatenate((first, [len(x)])))))
            won = won[np.concatenate(([True], owner[won][1:] != owner[won][:-1]))]
            key[owner[won]] |= term[won].astype(np.uint64) << np.uint64(48 - 16 * draw)
    return key.view(np.int64)


class InvertedIndex:
    """BM25 postings of the documents of one shard, by term, with the frequencies of the whole corpus."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, n_docs: int, mean_length: float):
        rows = [np.unique(ids, return_counts=True) for ids in items]
        term, n = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (0, 1))
        self._build(term, n, np.array([len(r[0]) for r in rows], np.int64), np.array([len(x) for x in items], float), inverse_frequencies(df, n_docs), mean_length)

    @classmethod
    def of_terms(cls, term: np.ndarray, n: np.ndarray, count: np.ndarray, length: np.ndarray, idf: np.ndarray, mean_length: float) -> InvertedIndex:
        """From ``unpacked_terms`` and the number of tokens of each document."""
        self = cls.__new__(cls)
        self._build(term, n, count, length, idf, mean_length)
        return self

    def _build(self, term, n, count, length, idf, mean_length) -> None:
        owner = np.repeat(np.arange(len(count)), count)
        live = idf[term] > 0
        term, n, owner = term[live], n[live], owner[live]
        self.query, self.edge = term, np.searchsorted(owner, np.arange(len(count) + 1))
        order = np.argsort(term, kind="stable")
        t, n, self.owner = term[order], n[order].astype(float), owner[order]
        self.weight = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[self.owner] / max(mean_length, 1.0)))
        self.starts = np.searchsorted(t, np.arange(len(idf) + 1))
        self.n = len(count)

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every document for the terms of ``item``."""
        t = self.query[self.edge[item] : self.edge[item + 1]]
        a, n = self.starts[t], self.starts[t + 1] - self.starts[t]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(t) else np.zeros(0, np.int64)
        return np.bincount(self.owner[at], self.weight[at], minlength=self.n)


def fill_windows(index: InvertedIndex, left: np.ndarray, digest: np.ndarray, window: int, open_: list[tuple[int, int, set]] | None = None, least: float = 0.0) -> tuple[list, list]:
    """What is added to the ``open_`` windows, given as (seed, room, digests of their texts), and the new
    windows, both as lists of (document, tokens of it used before, length) over ``left`` tokens of each.

    The first document with tokens left is the seed; its BM25 neighbours that are still unused follow,
    best first, until the window is full. One whose text the window has already is passed over as
    long as there is another. The one that no longer fits is cut, and its rest stays unused for a later
    window, so only the last window can have room. With ``least`` above 0, only neighbours count
    whose score is at least that share of the seed's own, a seed without any opens no window, and
    windows may keep room.
    """
    left, used = left.copy(), np.zeros(len(left), np.int64)

    def ranked(seed: int, scores: np.ndarray):
        rest = np.flatnonzero(left > 0)
        if least:
            rest = rest[(scores[rest] >= least * scores[seed]) & (scores[rest] > 0)]
        most = 32
        while len(rest):  # the best few are enough for most windows
            s, some = scores[rest], np.arange(len(rest))
            if len(rest) > most:  # ties with the last of them belong to them
                some = np.flatnonzero(s >= -np.partition(-s, most - 1)[most - 1])
            yield from rest[some[np.argsort(-s[some], kind="stable")]].tolist()
            rest, most = np.delete(rest, some), most * 8

    def filled(seed: int, room: int, have: set, begin: bool) -> list[tuple[int, int, int]]:
        pieces, passed = [], []

        def take(i: int) -> None:
            nonlocal room
            k = int(min(left[i], room))
            pieces.append((i, int(used[i]), k))
            have.add(digest[i])
            used[i] += k
            left[i] -= k
            room -= k

        if begin and not least:
            take(seed)
        if room:
            for i in ranked(seed, index.scores(seed)):
                if i == seed or digest[i] in have or (begin and digest[i] == digest[seed]):
                    passed.append(i)
                    continue
                if begin and not pieces:
                    take(seed)
                if room:
                    take(i)
                if not room:
                    break
        while room and passed and not least:
            take(passed.pop(0))
        return pieces

    added = [filled(seed, room, have, False) for seed, room, have in open_ or ()]
    new = (filled(seed, window, set(), True) for seed in range(len(left)) if left[seed])
    return added, [x for x in new if x]


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, window: int = 2048, end_id: int = 1, tokens_per_shard: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit),
    ``doc_tokens, sequence_id, offset``. Full windows of a long document stand alone; what is left of it is
    packed with others. The index over whole documents is cut into shards of about
    ``tokens_per_shard`` tokens to pack. Documents are dealt to them in the order of their
    ``signatures``, so those that share rare terms meet in one shard, and every shard has an inverted
    index with idf and mean length of the whole corpus. In it each seed asks for its BM25
    neighbours and its window takes those that are unused, best first. They are dealt ``TURNS`` times by
    other draws; before the last time windows take only near neighbours and stay open. A
    neighbour that is in no shard with the seed is not found; shards do not change with the size
    of the corpus, their number does.

    Of documents with the same ids one is dealt by its signature and the rest at random, and a window takes
    none twice while its shard has others: a third of all rows may be one text. Null or empty texts
    have one token, ``end_id``. Rows that repeat an id are separate documents. A very long text is
    one task's work to encode, its windows are cut in one go. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    if path is None:
        path = vocabulary_path()
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    tokens = tokenised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), path, pattern, end_id, window=window)
    real = tokens.where("doc_tokens >= 0")
    n_docs, total = real.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    mean, idf = total / max(n_docs, 1), inverse_frequencies(token_counts(tokens), n_docs)

    def keyed(batches):
        for b in batches:
            terms = unpacked_terms(b["terms"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["item"], b["left"], b["digest"], *(pa.array(signatures(*terms, idf, turn)) for turn in range(TURNS))], names=["item", "left", "digest", *(f"key{turn}" for turn in range(TURNS))])

    def fill(turn: int):
        share = NEAR if turn + 1 < TURNS else 0.0

        def run(t):
            t = t.sort_by([("room", "ascending"), ("item", "ascending")])
            item, left, start, room = (t[c].to_numpy() for c in ("item", "left", "start", "room"))
            index = InvertedIndex.of_terms(*unpacked_terms(t["terms"].to_pylist()), t["doc_tokens"].to_numpy().astype(float), idf, mean)
            open_ = [(i, int(room[i]), set(np.frombuffer(t["have"][i].as_py(), "<i8").tolist())) for i in np.flatnonzero(room > 0).tolist()]
            have, out = t["digest"].to_pylist(), []
            added, new = fill_windows(index, left, np.array(have), window, open_, share)
            for seed, offset, held, pieces in [*((i, window - r, h, x) for (i, r, h), x in zip(open_, added, strict=True)), *((x[0][0], 0, None, x) for x in new)]:
                held = np.array(sorted(held or {have[i] for i, _, _ in pieces}), "<i8").tobytes()
                for i, used, k in pieces:
                    out.append((item[i], start[i] + used, k, item[seed], offset, held))
                    offset += k
            return pa.table({c.split()[0]: pa.array([r[k] for r in out], pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(_FILLED.split(", "))})

        return run

    tail = (F.floor(F.col("doc_tokens") / window) * window).cast("long")
    rest = (F.col("doc_tokens") - tail).alias("left")
    texts = real.select("item", "doc_tokens", "digest", "terms")
    schema = "item long, left long, digest long, " + ", ".join(f"key{turn} long" for turn in range(TURNS))
    keys = settle(real.select("item", rest, "digest", "terms").where("left > 0").mapInArrow(keyed, schema))
    several = settle(keys.groupBy("digest").agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = settle(join_groups(keys.select("item", "digest"), several, "digest", "n", n_docs).where("item > first").select("item"))
    waiting = real.select("item", tail.alias("start"), rest).where("left > 0")
    windows, parts = None, []
    for turn in range(TURNS):
        # Documents that wait, and open windows: these stand where their seed stands and have no tokens left.
        here = waiting.select("item", "start", "left", F.lit(0).cast("long").alias("room"), F.lit(b"").alias("have"))
        if windows is not None:
            seeds = windows.join(waiting.select("item", "start", "left"), "item", "left")
            here = here.join(windows.select("item"), "item", "left_anti").unionByName(seeds.select("item", F.coalesce("start", F.lit(0).cast("long")).alias("start"), F.coalesce("left", F.lit(0).cast("long")).alias("left"), "room", "have"))
        here = settle(here)
        shards = max(1, round((here.agg(F.sum("left")).first()[0] or 0) / tokens_per_shard))
        own = here.select("item", "left").join(keys.select("item", F.col(f"key{turn}").alias("key")), "item")
        by_key = balanced_shards(own.join(copies, "item", "left_anti"), shards, ["key", "item"], "left").select("item", "shard")
        if turn + 1 == TURNS:
            by_key = by_key.unionByName(own.join(copies, "item", "left_semi").select("item", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard")))
        work = here.join(by_key, "item").join(texts, "item")
        filled = settle(work.groupBy("shard").applyInArrow(fill(turn), _FILLED))
        parts.append(filled.select("item", "start", "length", "seq", "offset"))
        if turn + 1 < TURNS:
            gone = filled.groupBy("item").agg(F.sum("length").alias("gone"))
            waiting = settle(waiting.join(gone, "item", "left").select("item", (F.col("start") + F.coalesce("gone", F.lit(0))).alias("start"), (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")).where("left > 0"))
            full = filled.groupBy(F.col("seq").alias("item")).agg((F.lit(window) - F.max(F.col("offset") + F.col("length"))).alias("room"), F.first("have").alias("have"))
            windows = settle(full.where("room > 0"))
    filled = parts[0]
    for part in parts[1:]:
        filled = filled.unionByName(part)

    def cut(batches):
        import zstandard

        unpack, kinds = zstandard.ZstdDecompressor(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for b in batches:
            out, size = [], 0
            for item, doc_id, n, packed, pieces in zip(*(b[c] for c in ("item", "doc_id", "doc_tokens", "packed", "pieces")), strict=True):
                ids, doc_id, n = np.frombuffer(unpack.decompress(packed.as_py()), "<u2"), doc_id.as_py(), n.as_py()
                whole = ((k * window, window, item.as_py() + 1 + k, 0) for k in range(n // window))
                for p in (*whole, *(tuple(x.values()) for x in pieces.as_py() or ())):
                    start, length, seq, offset = p
                    out.append((doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), n, seq, offset))
                    size += 4 * length
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    pieces = filled.groupBy("item").agg(F.collect_list(F.struct("start", "length", "seq", "offset")).alias("pieces"))
    return real.select("item", "doc_id", "doc_tokens", "packed").join(pieces, "item", "left").mapInArrow(cut, _PIECES)


def op1_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
