"""Sampling and splitting by hashed uniforms: repeatable on any partitioning."""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import gumbel, hash_digits, hash_uniform
from .rules import c


#: A bin of the hash has about so many rows at most.
ROWS_PER_BIN = 1 << 18
#: Draws are ranked in bins of the first hex digits of the hash, 4096 of them, whose counts the driver sees.
BIN_DIGITS = 3


def uniform_sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows without replacement: those with the smallest hash. Each task keeps n, so no full sort."""
    return df.orderBy(hash_uniform(seed, key), key).limit(n)


def gumbel_sample(df: DataFrame, n: int, seed: str, key: str, log_weight: Column) -> DataFrame:
    """n rows without replacement with probability by weight: the largest log w + Gumbel noise."""
    return df.orderBy(F.desc(log_weight + gumbel(hash_uniform(seed, key))), key).limit(n)


def shuffle(df: DataFrame, seed: str, key: str) -> DataFrame:
    return df.orderBy(hash_uniform(seed, key), key)


def _cut_points(df: DataFrame, by: str, seed: str, key: str, rows: int | None = None) -> DataFrame:
    """Exact rank of each row in its stratum by hash, without gathering a stratum in one task: ranks
    inside bins of the hash plus the counts of the bins before. ``rows`` is their number, where it is known."""
    n_bins = max(256, (df.count() if rows is None else rows) // ROWS_PER_BIN)
    out = df.withColumn("_u", hash_uniform(seed, key)).withColumn("_bin", F.floor(F.col("_u") * n_bins).cast("int"))
    per = out.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("_size", F.sum("_n").over(Window.partitionBy(by))).drop("_n")
    per = per.select(F.col(by).alias("_by"), F.col("_bin").alias("_b"), "_before", "_size")
    out = out.join(per, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy(by, "_bin").orderBy("_u", key))
    return out.withColumn("_rank", rank + F.col("_before")).drop("_u", "_bin", "_by", "_b", "_before")


def stratified_split(df: DataFrame, by: str, shares: dict[str, float], seed: str, key: str) -> DataFrame:
    """Adds ``split``: in each stratum the first round(share * size) rows by hash go to the first name,
    and so on; the last name takes the rest. Counts are exact."""
    names, ranked = list(shares), _cut_points(df, by, seed, key)
    split, total = F.lit(names[-1]), 0.0
    bounds = []
    for n in names[:-1]:
        total += shares[n]
        bounds.append((n, F.round(F.col("_size") * total)))
    for n, b in reversed(bounds):
        split = F.when(F.col("_rank") <= b, F.lit(n)).otherwise(split)
    return ranked.withColumn("split", split).drop("_rank", "_size")


def stratified_sample(df: DataFrame, by: str, counts: dict[str, int], seed: str, key: str) -> DataFrame:
    """Exactly ``counts[value]`` rows of each stratum by hash."""
    want = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    return _cut_points(df, by, seed, key).where(F.col("_rank") <= want[F.col(by)]).drop("_rank", "_size")


def stratum_sample(df: DataFrame, by: str, n: int, seed: str, key: str) -> DataFrame:
    """At most ``n`` rows of every stratum by hash."""
    return _cut_points(df, by, seed, key).where(F.col("_rank") <= n).drop("_rank", "_size")


def split_metadata(df: DataFrame, positive: Column) -> DataFrame:
    """Rows and positive rate per side."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(positive.cast("double")).alias("positive_rate"))


def _next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def draw_places(df: DataFrame, sizes: list[int] | tuple[int, ...], repeats: int, seed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_place`` (long, from 0, in the random order of a hash), and the places (n, repeat, _place) of each draw.

    A draw takes the places first + step * i modulo the least prime that is no less than the number of rows, until it has n
    of them; first and step come from a hash of the draw. In a random order every such set is a random sample, and what is
    read is the rows drawn, not all rows for each draw. Rows with equal keys and hashes may swap places."""
    total, ranked = _placed(df, seed, key)
    prime = _next_prime(total)
    # A few numbers for each draw, so that none of its rows computes them again. Places past the last row fall out.
    ids = [(n, r, *_stride(f"{seed}:{n}:{r}", min(n, total), total, prime)) for n in sizes for r in range(repeats)]
    ids = df.sparkSession.createDataFrame(ids, "n int, repeat int, _first long, _step long, _last long").repartition(max(1, min(sum(x[-1] for x in ids) >> 18, 200)), "n", "repeat")
    tried = ids.select("n", "repeat", "_first", "_step", F.explode(F.sequence(F.lit(1).cast("long"), "_last")).alias("_i")) if total else ids.where("false").withColumn("_i", F.lit(0).cast("long"))
    return ranked, tried.select("n", "repeat", ((F.col("_first") + F.col("_step") * F.col("_i")) % prime).alias("_place")).where(F.col("_place") < total)


def _stride(name: str, n: int, total: int, prime: int) -> tuple[int, int, int]:
    """First place and step of a draw, and how many places it tries until ``n`` of them are less than ``total``."""
    digits = hashlib.md5(name.encode()).hexdigest()
    first, step = int(digits[:8], 16) % prime, int(digits[8:16], 16) % max(1, prime - 1) + 1
    back, last = pow(step, -1, prime), n
    for out in sorted((place - first) * back % prime or prime for place in range(total, prime)):
        last += out <= last
    return first, step, last


def _placed(df: DataFrame, seed: str, key: str) -> tuple[int, DataFrame]:
    """The number of rows, and ``df`` with ``_place``. One pass counts the rows of each bin of the hash, a second ranks them there;
    a table with more than 2^18 rows in each of 4096 bins gets more bins."""
    binned = df.withColumn("_u", hash_digits(seed, key)).withColumn("_bin", F.substring("_u", 1, BIN_DIGITS))
    counts = sorted((r["_bin"], r["count"]) for r in binned.groupBy("_bin").count().collect())
    total = sum(n for _, n in counts)
    if total > 16**BIN_DIGITS * ROWS_PER_BIN:
        ranked = _cut_points(df.withColumn("_all", F.lit(0)), "_all", seed, key, total)
        return total, ranked.select(*df.columns, (F.col("_rank") - 1).cast("long").alias("_place"))
    starts = [(b, at - n) for (b, n), at in zip(counts, accumulate(n for _, n in counts), strict=True)]
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_u", key))
    ranked = binned.withColumn("_in", inside).join(F.broadcast(df.sparkSession.createDataFrame(starts, "_bin string, _start long")), "_bin")
    return total, ranked.select(*df.columns, (F.col("_start") + F.col("_in") - 1).alias("_place"))


def draws(df: DataFrame, sizes: list[int] | tuple[int, ...], repeats: int, seed: str, key: str) -> DataFrame:
    """(n, repeat, rows...): ``repeats`` draws of each size without replacement (all rows where there are fewer)."""
    ranked, places = draw_places(df, sizes, repeats, seed, key)
    return with_places(places, ranked).select("n", "repeat", *df.columns)


def with_places(places: DataFrame, placed: DataFrame) -> DataFrame:
    """Both by ``_place``. The plan takes the places for as few as the draws they are made from, and would broadcast them."""
    return places.hint("merge").join(placed, "_place")


def ordinal_rank(df: DataFrame, value: str, key: str, name: str, bins: int = 64) -> DataFrame:
    """Adds ``name``: the place of each row, from 1, in the order of a numeric ``value`` (nulls first) and then of ``key``.

    No task gathers more than a bin: values are cut at approximate percentiles, and rows of a value that is such a cut, as
    frequent ones are, at those of a numeric key. Counts of the bins before (at most ``bins`` squared, twice) are added up."""
    v, k = c(value), c(key)
    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    points = [i / bins for i in range(1, bins)]
    at = df.agg(F.percentile_approx(v, points), *([F.percentile_approx(k, points)] if numeric else [])).first()
    cuts, key_cuts = (sorted({x for x in (part or []) if x == x}) for part in (at[0], at[1] if numeric else []))
    upto = lambda cut, col: F.size(F.filter(F.array(*map(F.lit, cut)), lambda x: x <= col)) if cut else F.lit(0)
    equal = F.coalesce(v.isin(*cuts), F.lit(False)) if cuts else F.lit(False)
    binned = df.withColumn("_b", F.struct(upto(cuts, v).alias("i"), (~equal).alias("after"), F.when(equal, upto(key_cuts, k)).otherwise(F.lit(0)).alias("j")))
    counts = binned.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_b").alias("_bin"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(v.asc_nulls_first(), k))
    ranked = binned.withColumn("_in", inside).join(F.broadcast(before), F.col("_b") == F.col("_bin"))
    return ranked.select(*[c(x) for x in df.columns], (F.col("_in") + F.col("_before")).alias(name))
