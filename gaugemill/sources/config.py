"""Typed settings from files: every key has to be there, none is made up, none is passed over."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    pass


def parsed(kind: type, values: dict, where: str = ""):
    """``kind``, a dataclass, from a mapping. A key that is missing, unknown or of another type raises by its name,
    even where the class has a default; nested dataclasses are read the same way."""
    where = where or kind.__name__
    if not isinstance(values, dict):
        raise ConfigError(f"{where}: not a mapping")
    hints, wanted = get_type_hints(kind), {f.name for f in fields(kind)}
    if gone := sorted(wanted - values.keys()):
        raise ConfigError(f"{where}: missing {', '.join(f'{where}.{k}' for k in gone)}")
    if odd := sorted(values.keys() - wanted):
        raise ConfigError(f"{where}: unknown {', '.join(f'{where}.{k}' for k in odd)}")
    out = {}
    for k, v in values.items():
        t = hints[k]
        if hasattr(t, "__dataclass_fields__"):
            v = parsed(t, v, f"{where}.{k}")
        elif t is float and type(v) is int:
            v = float(v)
        elif type(v) is not t:
            raise ConfigError(f"{where}.{k}: {v!r} is no {t.__name__}")
        out[k] = v
    return kind(**out)


def load(spark: SparkSession, kind: type, path: str):
    """From a JSON document in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ConfigError(f"{path}: not one document")
    try:
        values = json.loads(rows[0][0])
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    return parsed(kind, values)


def save(spark: SparkSession, config, path: str) -> None:
    from dataclasses import asdict

    spark.createDataFrame([(json.dumps(asdict(config), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def one_row(spark: SparkSession, config) -> DataFrame:
    """The settings as a table of one row, to be joined with what they judge."""
    names = {bool: "boolean", int: "long", float: "double", str: "string"}
    hints = get_type_hints(type(config))
    kept = [f.name for f in fields(config) if hints[f.name] in names]
    return spark.createDataFrame([tuple(getattr(config, k) for k in kept)], ", ".join(f"{k} {names[hints[k]]}" for k in kept))
