"""Connected components of a link table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle_table


SALTS = 8


def _by_hub(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join in which one key may have most rows of ``left``, narrow ones, and ``right`` has one row for each:
    the rows of a key are dealt over ``SALTS`` tasks and the row that they look for goes to each. Files of ids are much smaller
    than their rows, and the salts are not counted: a plan by size would broadcast ``right``, so a merge is asked for."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def _settled(df: DataFrame) -> DataFrame:
    """As a table, whose size is that of its files. A checkpoint would keep the optimiser's guess, and a join's guess is the
    product of those of its sides: over rounds of joins it grows to a number that the driver's memory does not hold."""
    return settle_table(df, "components")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links`` (columns a, b).

    Each round, every remaining node hooks to its smallest neighbour if that is smaller than itself,
    paths are halved until all end in roots (a logarithm of their length), and the links are rewritten
    between the roots; links inside one root vanish. A hub with very many links costs one partial minimum
    and joins whose rows are dealt over several tasks. Nothing reaches the driver but the number of links left. Nulls and loops are ignored.
    """
    links = _settled(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while links.limit(1).count():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        hook, moved = _settled(hook), True
        while moved:
            far = _settled(_by_hub(hook, hook.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            hook, moved = far.select("a", "p"), far.where("moved").limit(1).count() > 0
        if found is None:
            found = hook.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            step = hook.select(F.col("a").alias("component"), F.col("p").alias("_root"))
            found = _settled(_by_hub(found, step, "component", "left").select("id", F.coalesce("_root", "component").alias("component")))
        of = lambda c: hook.select(F.col("a").alias(c), F.col("p").alias(f"_{c}"))  # noqa: E731, B023
        links = _by_hub(_by_hub(links, of("a"), "a"), of("b"), "b").where("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        links = _settled(links.distinct())
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.hint("merge")
