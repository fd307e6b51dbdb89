"""What the corpus operators share: tables, the shared folder, text measures."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract here.
WS = r"[\x20\x09-\x0D]"
#: Runs of white space that are not already one single space.
WS_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is
    unset and Spark runs on one machine (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(sc, "_gaugemill_shared", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="gaugemill-")
            atexit.register(shutil.rmtree, named, True)
            sc._gaugemill_shared = named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gaugemill-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation and a
    second reader sees the same rows. Used for narrow tables (ids, sizes, digests, links)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle_table(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """The same as Parquet, for wide tables of which later steps read a few columns."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``groups`` that has their ``key``, inner, without ``size_col`` groups of
    many rows meeting in one task.

    ``size_col`` says how many of the ``total`` rows a group has. Groups of more than a ten-thousandth of
    all rows (and more than 1,000) can be 10,000 at most: they are broadcast, and their rows
    stay where they are read. All others meet by shuffle. Both inputs are read twice.
    """
    hot = F.broadcast(groups.where(F.col(size_col) > max(1000, total // 10_000)))
    cold = groups.where(F.col(size_col) <= max(1000, total // 10_000))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one called ``row``, so that none meets a name that an operator gives; ``row.*`` frees them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``docs`` has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; the text may be null (0)."""
    trimmed = F.regexp_replace(F.coalesce(col, F.lit("")), rf"^{WS}+|{WS}+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, rf"{WS}+"))).cast("long")
