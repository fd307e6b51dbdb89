"""Versioned models, and names for versions that move by one rename."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from . import store

_VERSION = re.compile(r"v(\d{6})")


class ModelRegistry:
    """``root/versions/v000001``, ... hold whole saved Spark models; ``root/aliases/<name>`` says which one a name means.

    A version is saved aside and appears by a rename, so a half-written one is never seen; an alias file is replaced by
    a rename, so a reader finds the old version or the new one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        return [int(m[1]) for n in store.names(self.spark, f"{self.root}/versions") if (m := _VERSION.fullmatch(n))]

    def path(self, version: int) -> str:
        return f"{self.root}/versions/v{version:06d}"

    def save(self, model, **facts) -> int:
        """The number of a new version with ``model`` and what is known of it. Writers at the same time get different ones."""
        tmp = store.aside(self.path(0))
        model.write().save(f"{tmp}/model")
        text = json.dumps({"class": f"{type(model).__module__}.{type(model).__qualname__}", "facts": facts})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{tmp}/about")
        version = max(self.versions(), default=0) + 1
        while not store.move(self.spark, tmp, self.path(version)):
            version += 1
        return version

    def about(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path(version)}/about").first()[0])

    def point(self, alias: str, version: int) -> None:
        """Moves ``alias`` to ``version``, which has to be there."""
        if version not in self.versions():
            raise KeyError(f"no version {version}")
        folder = store.aside(f"{self.root}/aliases/{alias}")
        self.spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.text(folder)
        part = next(n for n in store.names(self.spark, folder) if n.startswith("part-"))
        store.replace(self.spark, f"{folder}/{part}", f"{self.root}/aliases/{alias}")
        store.delete(self.spark, folder)

    def version_of(self, alias: str) -> int:
        if not store.exists(self.spark, f"{self.root}/aliases/{alias}"):
            raise KeyError(f"no alias {alias}; point one at a version first")
        return int(self.spark.read.text(f"{self.root}/aliases/{alias}").first()[0])

    def load(self, alias: str):
        """The model that ``alias`` means now."""
        version = self.version_of(alias)
        module, _, name = self.about(version)["class"].rpartition(".")
        if not module.startswith("pyspark.ml"):
            raise TypeError(f"{module}.{name} is no Spark model")
        from importlib import import_module

        return getattr(import_module(module), name).load(f"{self.path(version)}/model")
