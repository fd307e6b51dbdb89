"""Files of any store that Spark reaches: existence, listing, and renames that show a whole folder or none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly under a folder; nothing if it is not there."""
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and length of every file at or under ``path``, empty ones too (Spark's readers pass those over)."""
    at, fs = _fs(spark, path)
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith((".", "_")):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """One rename; false if the target is there already, and then nothing has changed."""
    a, fs = _fs(spark, source)
    b, _ = _fs(spark, target)
    fs.mkdirs(b.getParent())
    # A rename onto a folder would put the source inside it.
    return not fs.exists(b) and fs.rename(a, b)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """One rename of a file over another."""
    a, _ = _fs(spark, source)
    b, fs = _fs(spark, target)
    fs.mkdirs(b.getParent())
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri() if b.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(a), fs.makeQualified(b), options)


def aside(path: str) -> str:
    """A name beside ``path`` for what is not finished yet."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/.{tail}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that appears whole or not at all; if another has written it meanwhile, theirs stays."""
    spark, tmp = df.sparkSession, aside(path)
    df.write.parquet(tmp)
    if not move(spark, tmp, path):
        delete(spark, tmp)
