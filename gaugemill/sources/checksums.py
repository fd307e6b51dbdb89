"""Checksums of files by blocks, and a table of what was expected."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BLOCK_BYTES = 64 << 20
_BLOCKS = "path string, block long, sha256 string"
_KNOWN = "name string, digest string, length long"


def block_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, block, sha256`` of every block of every file under ``path``: the blocks of one large file go to many tasks. An
    empty file is one empty block."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for file, block, length in zip(*(batch[c].to_pylist() for c in ("path", "block", "length")), strict=True):
                there, at = fs.FileSystem.from_uri(file)
                with there.open_input_file(at) as f:
                    f.seek(block * block_bytes)
                    sha, left = hashlib.sha256(), min(block_bytes, length - block * block_bytes)
                    while left and (piece := f.read(min(left, 1 << 20))):
                        sha.update(piece)
                        left -= len(piece)
                    if left:
                        raise ValueError(f"{file} has become shorter while it was read")
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["block"], pa.array(out)], names=["path", "block", "sha256"])

    files = spark.createDataFrame(store.files(spark, path), "path string, length long")
    last = F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1)) - 1
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    return blocks.repartition("path", "block").mapInArrow(run, _BLOCKS)


def file_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``name, digest, length``: the SHA-256 over a file's block digests in order, so it depends on the size of blocks. A file's
    list has one digest for each block."""
    per = block_digests(spark, path, block_bytes).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"]).alias("blocks"))
    lengths = spark.createDataFrame(store.files(spark, path), "path string, length long")
    return per.join(lengths, "path").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2(F.concat_ws(",", F.lit(str(block_bytes)), F.col("blocks")), 256).alias("digest"), "length")


def verify(spark: SparkSession, path: str, known: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``name, status`` of each file under ``path`` against the table ``known``: ``match``, ``mismatch``, ``adopted`` where
    nothing was expected, ``missing`` where a file is expected and not there.

    What is adopted is written back, as a new part of the table; what is known is never changed, so a second call gives match. Raises
    if two files have one name."""
    found = file_digests(spark, path, block_bytes)
    found = spark.createDataFrame(found.collect(), found.schema)  # one row for each file, for three readers
    if found.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two files have one name")
    old = spark.read.schema(_KNOWN).parquet(known) if store.exists(spark, known) else spark.createDataFrame([], _KNOWN)
    old = old.groupBy("name").agg(F.min_by("digest", "digest").alias("expected"))
    both = found.join(old, "name", "full")
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("expected").isNull(), "adopted").when(F.col("digest") == F.col("expected"), "match").otherwise("mismatch")
    told = both.select("name", status.alias("status"), "digest", "length").collect()
    if new := [(r.name, r.digest, r.length) for r in told if r.status == "adopted"]:
        spark.createDataFrame(new, _KNOWN).coalesce(1).write.mode("append").parquet(known)
    return spark.createDataFrame([(r.name, r.status) for r in told], "name string, status string")


def needs_fetch(spark: SparkSession, path: str, known: str, name: str, block_bytes: int = BLOCK_BYTES) -> bool:
    """Whether a file has to be fetched (again): it is not there, or is not what is expected. One that is there and unknown is adopted."""
    if not store.exists(spark, f"{path.rstrip('/')}/{name}"):
        return True
    return verify(spark, f"{path.rstrip('/')}/{name}", known, block_bytes).where(F.col("name") == name).first().status == "mismatch"
