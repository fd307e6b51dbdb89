"""Results kept by what they were computed from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import exists, write_once


def content_key(inputs: dict[str, DataFrame], params: dict) -> str:
    """SHA-256 over the rows of the inputs, in any order, their schemas, and the parameters.

    A table counts by its rows and two sums of 64-bit hashes of them, added as decimals, so that repeated rows
    do not cancel; each task sends one row."""
    told: dict = {"params": params}
    for name, df in inputs.items():
        cols = [F.col(f"`{c}`") for c in df.columns]
        sums = [F.sum(F.xxhash64(*salt, *cols).cast("decimal(38,0)")) for salt in ([F.lit("a")], [F.lit("b")])]
        row = df.agg(F.count(F.lit(1)), *sums).first()
        told[name] = [df.schema.simpleString(), *map(str, row)]
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def cached(folder: str, inputs: dict[str, DataFrame], params: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The result for these inputs and parameters, read if it was computed before, else computed and written once.

    Inputs are read for their key; a changed row or parameter gives another key. A write that was cut off is
    under another name and is never read."""
    spark = next(iter(inputs.values())).sparkSession
    path = f"{folder.rstrip('/')}/{content_key(inputs, params)}"
    if not exists(spark, path):
        write_once(compute(), path)
    return spark.read.parquet(path)
