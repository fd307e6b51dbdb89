"""Exact dedup against a history held in a minimal perfect hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, join_groups, settle, table, text_or_empty, whole_row
from .mph import PerfectHash, key_words

_INDEX = "shard int, sizes array<int>, bits binary, digests binary, winners binary, counts binary"
_FOUND = "digest binary, keep_id long, group_size long"


def _rows(column, width: int) -> np.ndarray:
    """A binary column of equal widths as n x width bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _build(key, t):
    digests = _rows(t["digest"], 32)
    mph = PerfectHash.build(words := key_words(digests))
    order = np.argsort(mph.slots(words))
    sizes, bits = mph.packed()
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": [bits], "digests": [digests[order].tobytes()],
        "winners": [t["winner"].to_numpy().astype("<i8")[order].tobytes()], "counts": [t["n"].to_numpy().astype("<i8")[order].tobytes()],
    })


def _look_up(key, index, new):
    """All slots of one shard with what the new digests add, then the digests that history lacks."""
    digests, winners, counts = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(new.num_rows, bool)
    mine = _rows(new["digest"], 32) if new.num_rows else digests
    first, n = (new[c].to_numpy().astype(np.int64) for c in ("winner", "n"))
    if index.num_rows:
        row = {c: index[c][0].as_py() for c in ("sizes", "bits", "digests", "winners", "counts")}
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], "<i8"), np.frombuffer(row["counts"], "<i8").copy()
        if len(mine):
            slot = PerfectHash.unpacked(row["sizes"], row["bits"]).slots(key_words(mine))
            known = slot >= 0
            known[known] = (digests[slot[known]] == mine[known]).all(axis=1)  # the slot's whole digest decides
            np.add.at(counts, slot[known], n[known])
            winners = winners.copy()
            np.minimum.at(winners, slot[known], first[known])
            fresh = ~known
    keys = np.concatenate([digests, mine[fresh]])
    return pa.table({
        "digest": pa.array([k.tobytes() for k in keys], pa.binary()),
        "keep_id": pa.array(np.concatenate([winners, first[fresh]]), pa.int64()), "group_size": pa.array(np.concatenate([counts, n[fresh]]), pa.int64()),
    })


def digest_groups(history: DataFrame, incoming: DataFrame, per_shard: int = 20_000, least_shards: int = 256) -> DataFrame:
    """``digest`` (32 bytes), ``keep_id``, ``group_size`` over both tables, one row per distinct digest.

    Distinct historical digests are dealt over shards by their own bytes; each shard compiles a
    minimal perfect hash whose slots hold the full digest, the winner's id and the number of rows.
    Incoming digests, counted before they move, are looked up in the shard they belong to. A slot
    counts as a hit only if all 32 bytes agree; digests that no slot holds form groups of their own.
    Copies never meet in one task: a digest reaches its shard once, whatever its number of rows.
    The winner is the smallest id; a null id wins only if all are null.
    """
    per = lambda df: df.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    old = settle(per(history))
    shards = max(least_shards, old.count() // per_shard)
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    big = (1 << 63) - 1
    whole = lambda df: df.select("digest", F.coalesce("winner", F.lit(big)).alias("winner"), "n", shard)
    index = settle(whole(old).groupBy("shard").applyInArrow(_build, _INDEX))
    found = index.groupBy("shard").cogroup(whole(per(incoming)).groupBy("shard")).applyInArrow(_look_up, _FOUND)
    return found.withColumn("keep_id", F.when(F.col("keep_id") != big, F.col("keep_id")))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``digest`` to the ids of all rows.

    Texts are equal when identical after each run of ASCII white space is one space; null counts as
    the empty text, which is a text like any other. Rows up to the median id are the history, the
    rest arrive after it. ``kept`` marks every row that bears the smallest id of its group, so of
    rows that repeat both id and text all are marked; ``exact_dedup_rows`` keeps one of them.
    An empty table gives an empty result. Only ids and digests move; texts, however long, stay where they
    are read. Of a text that many rows share, the rows stay too: its group comes to them.
    """
    text = F.regexp_replace(text_or_empty(text_col), WS_RUN, " ")
    rows = settle(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
    middle, total = rows.agg(F.percentile_approx("id", 0.5), F.count(F.lit(1))).first()
    past = F.col("id") <= F.lit(middle if middle is not None else 0)
    groups = digest_groups(rows.where(past), rows.where(F.coalesce(~past, F.lit(True))))
    return join_groups(rows, settle(groups), "digest", "group_size", total).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that bear the smallest id of their group of equal texts;
    of rows that repeat both id and text, one. Null and empty texts are one group; a null id is the largest. An
    empty table gives an empty result. Whole texts, however long, move once, with their rows."""
    marked = exact_dedup(docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id")), "text", "id")
    kept = settle(marked.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")))
    text = F.regexp_replace(text_or_empty(text_col), WS_RUN, " ")
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("own_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("own"))
    rows = rows.join(kept.select("id", "digest"), (F.col("own") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    if kept.where("n > 1").limit(1).count():
        rows = rows.dropDuplicates(["own_id", "own"])
    return rows.select("row.*")


def op6_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
SQL = {"op6_exact_dedup": OP6_SQL}
