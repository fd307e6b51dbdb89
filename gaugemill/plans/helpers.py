"""Shared by the query modules: rounding on both sides, and the credit rows as SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import CREDIT_SQL

WITH_CREDIT = f"WITH credit AS {CREDIT_SQL}"


def shared_dir(spark) -> str:
    """Where the cluster says checkpoints go; on one machine without that setting (tests) a temporary folder for the session."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(sc, "_gaugemill_plans", None)
        if base is None:
            base = sc._gaugemill_plans = tempfile.mkdtemp(prefix="gaugemill-plans-")
            atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a new table in the shared folder, so that its readers do not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places (and -0 to 0), so that engines that add in another order agree."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def rsql(inner: str, plain: str = "", doubles: str = "", digits: int = 6, head: str = "") -> str:
    """``SELECT plain, round(doubles) FROM (inner)`` with an optional WITH clause in front."""
    cols = [x.strip() for x in plain.split(",") if x.strip()] + [f"round({x}::DOUBLE, {digits}) + 0.0::DOUBLE AS {x}" for x in map(str.strip, doubles.split(",")) if x]
    return f"{head} SELECT {', '.join(cols)} FROM ({inner})"
