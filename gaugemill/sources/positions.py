"""Rows numbered in the order of files, and what the footers of Parquet files say."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A list of so many files is small beside any table.
FEW_FILES = 100_000
_FOOTERS = "file string, row_group int, column string, type string, rows long, compressed long, plain long, nulls long"


def with_positions(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """The Parquet table with ``name``: gapless from 0 in the order of files by name, then of rows in them.

    A row knows its place in its file as it is read; one count for each file, from a scan without columns, gives the rows before the
    file. Nothing is sorted or shuffled up to 100,000 files. A column called ``name`` is replaced."""
    read = spark.read.parquet(path)
    rows = read.drop(name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    line = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = counts.select("_file", F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_before"))
    if len(read.inputFiles()) <= FEW_FILES:
        starts = F.broadcast(starts)
    return rows.join(starts, "_file").select((F.col("_before") + F.col("_index")).alias(name), *[F.col(f"`{c}`") for c in read.columns if c != name])


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk: ``file, row_group, column, type, rows, compressed, plain`` (bytes), ``nulls`` (null if not
    told). Only the ends of the files are read, each by one task."""

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out: dict = {c.split()[0]: [] for c in _FOOTERS.split(", ")}
            for file in batch.column(0).to_pylist():
                there, at = fs.FileSystem.from_uri(file)
                meta = pq.read_metadata(at, filesystem=there)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for k in range(meta.num_columns):
                        c = group.column(k)
                        nulls = c.statistics.null_count if c.statistics is not None and c.statistics.has_null_count else None
                        for n, v in zip(out, (file, g, c.path_in_schema, c.physical_type, group.num_rows, c.total_compressed_size, c.total_uncompressed_size, nulls), strict=True):
                            out[n].append(v)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    files = spark.read.format("binaryFile").load(path).select("path")  # listed, not read
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, _FOOTERS)


def byte_profile(spark: SparkSession, path: str) -> DataFrame:
    """Per column of a Parquet table: ``column, type, rows, row_groups, compressed, plain, nulls``, from footers alone."""
    return footers(spark, path).groupBy("column", "type").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("row_groups"), F.sum("compressed").alias("compressed"), F.sum("plain").alias("plain"), F.sum("nulls").alias("nulls"))
