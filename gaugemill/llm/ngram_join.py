"""N-gram Jaccard join: exact near-duplicate groups through signature trees.

1. Shingle hashes are dealt over buckets, five bytes each. A bucket sees which of its hashes occur in
   two different sets and returns those alone. A set of which over a quarter occurs in no other set
   cannot reach the threshold with any, so most documents end here.
2. Equal sets become one representative (smallest id).
3. By the prefix principle a similar pair shares one of the first  s - ceil(t n) + 1  of the s shared
   tokens in one global order (rarest first). Those with such a token in common form a block, and
   blocks that share a member a family. Large families are cut into pairs of parts.
4. Inside a family, signature trees are walked together; what they leave is decided exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, settle, settle_table, table, whole_row
from .components import components
from .mph import mixed
from .signature_tree import similar_pairs, spanning_links
from .textops import shingles, slices

CHUNK_BYTES = 6 << 20
_U = np.uint64
_BLOCKS = "bucket int, chunk long, counts binary, marks binary, low binary, high binary"
_NAMES, _KINDS = [x.split()[0] for x in _BLOCKS.split(", ")], (pa.int32(), pa.int64(), *[pa.binary()] * 4)
SHARED = "bucket int, chunk long, docs binary, tokens binary, rarity binary"
_SETS = "doc_id long, n_shingles long, mark binary, prefix int, tokens binary"


def shingle_measure(k: int):
    """Distinct shingle hashes of each text, how many they are, and 128 bits that stand for the set."""

    def measure(data, offsets):
        n = len(offsets) - 1
        h, owner = shingles(data, offsets, k)
        sizes, marks = np.bincount(owner, minlength=n), np.zeros((n, 2), _U)
        for c in (0, 1):
            np.add.at(marks[:, c], owner, mixed(h, 21 + c))
        marks[:, 1] += sizes.astype(_U)
        return h, owner, sizes, marks

    return measure


def emit(docs: DataFrame, measure, buckets: int) -> DataFrame:
    """Per chunk of texts and bucket: of the texts with a hash in it, their number in the chunk and how many hashes they
    have, and 32 bits of their mark; and the hashes as 32 + 8 bits. So what a chunk sends grows with its hashes, not with the
    buckets. Bucket < 0: the chunk's ids, sizes and 128-bit marks. ``measure`` gives for texts
    (hashes, owners sorted, size and mark of each text); rows are (id, text)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, held, parts = [], 0, []

        def flush():
            nonlocal ids, held, parts, seq
            chunk = (part << 32) + seq
            first = np.concatenate(([0], np.cumsum([len(x[2]) for x in parts])))
            h, doc = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + f for x, f in zip(parts, first, strict=False)])
            size, mark = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])
            head = [pa.array([x], t) for x, t in zip((-1 - chunk % 64, chunk, size.astype("<u4").tobytes(), mark.astype("<u8").tobytes(), _ids(ids), b""), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(head, names=_NAMES)
            b = (h % _U(buckets)).astype(np.int64)
            h40 = (h // _U(buckets)) & _U((1 << 40) - 1)
            key = b * len(size) + doc
            order = np.argsort(key, kind="stable")
            key, h40 = key[order], h40[order]
            run = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))  # one text in one bucket
            length = np.diff(np.concatenate((run, [len(key)])))
            b, doc = np.divmod(key[run], len(size))
            used, first = np.unique(b, return_index=True)
            runs, hashes = np.append(first, len(run)), np.append(run, len(key))[np.append(first, len(run))]
            wide = np.stack([doc, np.minimum(length, 65535)], axis=1).astype("<u4" if len(size) > 65535 else "<u2")
            cut = lambda x, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * (x.nbytes // max(1, len(x)))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            ids, held, parts, seq = [], 0, [], seq + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), chunk)), cut(wide, runs), cut(mark[doc, 0].astype("<u4"), runs), cut((h40 & _U(0xFFFFFFFF)).astype("<u4"), hashes), cut((h40 >> _U(32)).astype("u1"), hashes)], names=_NAMES
            )

        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                # Numbers of texts and counts of hashes are kept in 16 bits, so a huge text stands alone.
                if held and (held + len(data) > CHUNK_BYTES or len(ids) + j - i > 65535):
                    yield from flush()
                ids += batch.column(0)[i:j].to_pylist()
                parts.append(measure(data, offsets))
                held += len(data)
        if ids:
            yield from flush()

    return docs.mapInArrow(run, _BLOCKS)


_NULL_ID = -(1 << 63)


def _ids(ids: list) -> bytes:
    return np.array([_NULL_ID if x is None else x for x in ids], "<i8").tobytes()


def shared_hashes(key, t):
    """The hashes of one bucket that two different sets have, with a number that grows with how many."""
    bucket = key[0].as_py()
    if bucket < 0:
        return pa.table({"bucket": t["bucket"], "chunk": t["chunk"], "docs": t["low"], "tokens": t["marks"], "rarity": t["counts"]})
    doc, mark, h, at = [], [], [], [0]
    for counts, marks, low, high in zip(*(t[c].to_pylist() for c in ("counts", "marks", "low", "high")), strict=True):
        marks, low = np.frombuffer(marks, "<u4"), np.frombuffer(low, "<u4")
        texts, n = np.frombuffer(counts, "<u4" if len(counts) == 8 * len(marks) else "<u2").reshape(-1, 2).astype(np.int64).T
        if n.sum() != len(low):  # one text with 65,535 shingles or more in this bucket
            n[np.argmax(n)] += len(low) - n.sum()
        doc.append(np.repeat(texts.astype(np.uint32), n))
        mark.append(np.repeat(marks, n))
        h.append(low.astype(_U) | (np.frombuffer(high, "u1").astype(_U) << _U(32)))
        at.append(at[-1] + len(low))
    doc, mark, h = map(np.concatenate, (doc, mark, h))
    key_ = (h << _U(24)) | (mark & 0xFFFFFF).astype(_U)
    order = np.argsort(key_)
    h_, mark_ = h[order], mark[order]
    run = np.flatnonzero(np.concatenate(([True], h_[1:] != h_[:-1])))
    length = np.diff(np.concatenate((run, [len(h_)])))
    several = np.minimum.reduceat(mark_, run) != np.maximum.reduceat(mark_, run)
    sets = np.add.reduceat(np.concatenate(([True], key_[order][1:] != key_[order][:-1])).astype(np.int64), run)
    rare = np.where(several, np.minimum(255, 8 * np.log2(np.maximum(sets, 2))), 0).astype(np.uint8)
    score = np.zeros(len(h), np.uint8)
    score[order] = np.repeat(rare, length)
    rows = []
    for chunk, a, b in zip(t["chunk"].to_pylist(), at, at[1:], strict=False):
        hit = np.flatnonzero(score[a:b]) + a
        if len(hit):
            rows.append((bucket, chunk, doc[hit].astype("<u4").tobytes(), h[hit].astype("<u8").tobytes(), score[hit].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "chunk", "docs", "tokens", "rarity"), cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


def _sets(percent: int):
    """Puts a chunk's documents together again: those that may still have a partner get their shared
    tokens, rarest first, and the length of their prefix."""

    def run(t):
        bucket = t["bucket"].to_pylist()
        info = bucket.index(min(bucket))
        ids, n = np.frombuffer(t["docs"][info].as_py(), "<i8"), np.frombuffer(t["rarity"][info].as_py(), "<u4").astype(np.int64)
        marks = np.frombuffer(t["tokens"][info].as_py(), "<u8").reshape(-1, 2)
        rest = [i for i in range(len(bucket)) if i != info]
        doc = np.concatenate([np.frombuffer(t["docs"][i].as_py(), "<u4") for i in rest] or [np.zeros(0, "<u4")])
        rare = np.concatenate([np.frombuffer(t["rarity"][i].as_py(), "u1") for i in rest] or [np.zeros(0, "u1")])
        token = np.concatenate([token_names(np.frombuffer(t["tokens"][i].as_py(), "<u8"), bucket[i]) for i in rest] or [np.zeros(0, _U)])
        shared = np.bincount(doc, minlength=len(ids))
        alive = (100 * shared >= percent * n) & (n > 0)
        keep = alive[doc]
        doc, rare, token = doc[keep], rare[keep], token[keep]
        order = np.lexsort((token, rare, doc))
        doc, token = doc[order], token[order]
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        prefix = np.where(alive, shared + (-percent * n) // 100 + 1, 0)
        tokens = [token[edge[d] : edge[d + 1]].tobytes() if alive[d] else None for d in range(len(ids))]
        return pa.table({
            "doc_id": pa.array([None if x == _NULL_ID else x for x in ids.tolist()], pa.int64()), "n_shingles": pa.array(n), "mark": pa.array([m.tobytes() for m in marks], pa.binary()),
            "prefix": pa.array(prefix.astype(np.int32)), "tokens": pa.array(tokens, pa.binary()),
        })

    return run


def bucket_count(rows: DataFrame, hashes_per_byte: float) -> int:
    """A power of two that leaves about one million hashes to a bucket, so buckets do not grow."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(5, int(total * hashes_per_byte / (1 << 20)).bit_length())


def token_names(hashes: np.ndarray, bucket: int) -> np.ndarray:
    """A hash's name outside its bucket; it must not depend on the chunk."""
    return mixed(hashes | (_U(bucket) << _U(40)), 31)


def _prefix_rows(batches):
    for batch in batches:
        rep, tokens, prefix = (batch.column(c) for c in ("rep", "tokens", "prefix"))
        n = prefix.to_numpy(zero_copy_only=False).astype(np.int64)
        own = [np.frombuffer(x.as_py(), "<u8")[:k].astype(np.int64) for x, k in zip(tokens, n, strict=True)]
        sizes = [len(x) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), pa.array(np.repeat(rep.to_numpy(zero_copy_only=False), sizes), pa.int64())], names=["token", "rep"])


def _join_blocks(percent: int):
    """Rows sorted by (block, i, j) to links; a block is compared when its last row has come."""

    def run(batches):
        def links(t: pa.Table):
            block, i, j = (t[c].to_numpy() for c in ("block", "i", "j"))
            edge = np.concatenate(([0], np.flatnonzero((block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(block)]))
            rep, size, side, tokens = t["rep"].to_numpy(), t["n_shingles"].to_numpy(), t["side"].to_numpy(), t["tokens"].to_pylist()
            a_, b_ = [], []
            for a, b in zip(edge, edge[1:], strict=False):
                if b - a < 2:
                    continue
                p, q = similar_pairs([np.frombuffer(x, "<u8") for x in tokens[a:b]], size[a:b], side[a:b], percent)
                if len(p):
                    at, root = spanning_links(p, q, int(b - a))
                    a_.append(rep[a:b][at])
                    b_.append(rep[a:b][root])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a_, b_)], names=["a", "b"])

        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            last = [t[c][-1].as_py() for c in ("block", "i", "j")]
            open_ = (t["block"].to_numpy() == last[0]) & (t["i"].to_numpy() == last[1]) & (t["j"].to_numpy() == last[2])
            cut = int(np.argmax(open_))
            if cut:
                yield links(t.slice(0, cut).combine_chunks())
            left = t.slice(cut)
        if left is not None and left.num_rows:
            yield links(left.combine_chunks())

    return run


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 75, most: int = 1024, family_most: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: sets of ``k``-word shingles of the text with
    A-Z in lower case, linked when 100 * intersection >= percent * union.

    A text with fewer than ``k`` words is one shingle; null, empty or blank texts have none and link
    with nothing. Rows with a null id link with nothing and have a null component; rows that repeat
    an id share a component. An empty table gives an empty result. Shingles are compared by hashes
    of over 45 bits, so two different ones of a pair are taken for equal about once in 10^8 pairs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(rows, 1 / 6)
    shared = settle_table(emit(rows, shingle_measure(k), buckets).groupBy("bucket").applyInArrow(shared_hashes, SHARED), "shared", "lz4")
    sets = settle_table(shared.groupBy("chunk").applyInArrow(_sets(percent), _SETS), "sets", "lz4")

    known = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = settle(known.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    live = sets.where("tokens IS NOT NULL AND doc_id IS NOT NULL")
    reps = live.groupBy("mark").agg(F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"))
    reps = settle_table(reps.join(groups.drop("copies"), "mark").drop("mark"), "reps", "lz4")

    postings = reps.select("rep", "prefix", "tokens").mapInArrow(_prefix_rows, "token long, rep long")
    per = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    # Tokens with the same representatives make the same block; the smallest token stands for them.
    blocks = settle(per.where("n > 1").groupBy("n", "x", "y", "first").agg(F.min("token").alias("token")).select("token", "n", "first"))
    member = settle(postings.join(blocks, "token").select("token", "n", "first", "rep"))
    # Representatives that blocks chain together are compared as one family, so that each set moves once.
    family = components(member.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("family"))
    size = settle(family.groupBy("family").agg(F.count(F.lit(1)).alias("n")))
    family = settle(join_groups(family, size, "family", "n", family.count()))
    # A chain of more than ``family_most`` is left to its blocks one by one.
    wide = member.join(family.where(F.col("n") > family_most).select("rep"), "rep", "left_semi").select(F.col("token").alias("block"), F.lit(1).alias("kind"), "n", "rep")
    member = family.where(F.col("n") <= family_most).select(F.col("family").alias("block"), F.lit(0).alias("kind"), "n", "rep").unionByName(wide)
    subs = F.ceil(F.col("n") / most).cast("int")
    member = member.select(F.xxhash64("block", "kind").alias("block"), "rep", subs.alias("k"), F.pmod(F.xxhash64("rep", "block"), subs).cast("int").alias("sub"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    member = member.select("block", "rep", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), (F.col("sub") > F.col("other")).cast("int").alias("side"))
    work = member.join(reps.select("rep", "n_shingles", "tokens"), "rep").select("block", "i", "j", "side", "rep", "n_shingles", "tokens")
    links = work.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "rep").mapInArrow(_join_blocks(percent), "a long, b long")
    joined = components(links)

    group = groups.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("mark", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = join_groups(known.select("doc_id", "n_shingles", "mark"), settle(group), "mark", "copies", known.count())
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def near_dedup_rows(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose id is the smallest of its group of near copies. Rows
    without words or id are groups of their own, rows that repeat an id stay or go together."""
    kept = ngram_join(docs, k, percent, id_col=id_col, text_col=text_col).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("id"))
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("own_id"))
    return rows.join(settle(kept), F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")


def op3_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""

QUERIES = {"op3_ngram_join": op3_ngram_join}
SQL = {"op3_ngram_join": OP3_SQL}
