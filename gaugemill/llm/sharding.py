"""Sharding by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table


def balanced_shards(sized: DataFrame, n_shards: int, order_by: list[str], size_col: str = "size") -> DataFrame:
    """Contiguous shards of near equal size in the order of ``order_by``.

    Rows are range-partitioned and sorted by ``order_by``, every partition yields one total, the
    running sum of those totals gives each partition its global start, and a running sum inside the
    partition gives each row its own. A row goes to the shard in which its middle byte falls when
    the whole is cut into ``n_shards`` equal targets, so a shard differs from the target by at most
    half of the row on either cut.

    Adds ``shard int``, ``slot long`` (position inside the shard, gapless from 0) and
    ``start long`` (bytes before the row). Null sizes count as 0, null keys sort first, rows that
    are equal in all of ``order_by`` are told apart by no rule and may swap slots; an empty table
    gives an empty result. Columns named ``shard``, ``slot``, ``start`` or ``_part`` are replaced.
    """
    sized = sized.drop("shard", "slot", "start", "_part")
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    placed = settle(sized.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = settle(totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.col("_bytes"),
    ))
    total = totals.agg(F.max(F.col("_bytes_before") + F.col("_bytes"))).first()[0] or 0
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(totals.drop("_bytes"), "_part").select(
        *placed.columns,
        (F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("_bytes_before")).alias("start"),
        (F.count(F.lit(1)).over(inside) + F.col("_rows_before")).alias("_index"),
    )
    middle = (2 * F.col("start") + size).cast("decimal(38,0)") * n_shards
    shard = F.least(F.lit(n_shards - 1), F.floor(middle / F.lit(max(1, 2 * total)))).cast("int")
    rows = settle(rows.withColumn("shard", shard).drop("_part"))
    first = rows.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows at most
    if n_shards <= 10_000:  # else their number may grow with the table
        first = F.broadcast(first)
    return rows.join(first, "shard").withColumn("slot", F.col("_index") - F.col("_first")).drop("_index", "_first")


def op8_sharding(spark, sf_dir):
    """All documents into 16 contiguous shards (in the order of doc_id) under the law ``bytes``.

    Size is the UTF-8 length plus 1 (null text: 1). Equal texts are ordinary rows here: the law
    balances bytes and the cut is contiguous in doc_id, so copies need not share a shard.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return balanced_shards(sized, 16, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op8_sharding": op8_sharding}


def _crc_step(byte: int) -> int:
    """What one byte adds to a CRC-32: eight divisions by its polynomial."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


SQL = {
    "op8_sharding": f"""WITH s AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
      r AS (SELECT doc_id, CAST(octet_length(b) + 1 AS BIGINT) AS size, xor(4294967295::BIGINT, list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, ({[_crc_step(i) for i in range(256)]})[xor(a, x) % 256 + 1]), 4294967295::BIGINT)) AS text_crc32 FROM s),
      p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total FROM r),
      q AS (SELECT doc_id, size, text_crc32, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
      SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q"""
}
