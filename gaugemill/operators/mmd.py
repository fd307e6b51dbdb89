"""Kernel two-sample tests: one Arrow task per test, many tests at once."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_uniform

BANDWIDTH_ROWS = 2000
BLOCK_ROWS = 512
RESULT = "test string, mmd2 double, pvalue double, n long, m long, permutations int, bandwidth double, null_mean double, null_std double, detected boolean"


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def median_bandwidth(x: np.ndarray) -> float:
    """Median pairwise distance of at most 2000 rows drawn at random, at least 1e-12."""
    if len(x) > BANDWIDTH_ROWS:
        x = x[np.random.default_rng(0).choice(len(x), BANDWIDTH_ROWS, replace=False)]
    d = np.sqrt(_square_distances(x, x)[np.triu_indices(len(x), 1)])
    return max(float(np.median(d)) if len(d) else 0.0, 1e-12)


def rbf(x: np.ndarray, y: np.ndarray, h: float) -> np.ndarray:
    return np.exp(-_square_distances(x, y) / (2 * h * h))


def unbiased(xx: float, yy: float, xy: float, n: int, m: int) -> float:
    """From the three block sums of the kernel; the diagonal is taken out of the inner blocks only."""
    return (xx - n) / (n * (n - 1)) + (yy - m) / (m * (m - 1)) - 2 * xy / (n * m)


def permutation_test(x: np.ndarray, y: np.ndarray, h: float, permutations: int, seed: int) -> tuple[float, float, np.ndarray]:
    """MMD^2, p = (null values at or above it + 1) / (B + 1), and the null. Relabelled block sums come
    from one product of the kernel with all label vectors."""
    z, n, m = np.concatenate([x, y]), len(x), len(y)
    k = rbf(z, z, h)
    g = np.random.default_rng(seed)
    labels = np.zeros((n + m, permutations + 1))
    labels[:n, 0] = 1
    for b in range(permutations):
        labels[g.permutation(n + m)[:n], b + 1] = 1
    kl = k @ labels
    xx, total = (labels * kl).sum(0), k.sum()
    row = k.sum(1) @ labels
    xy = row - xx
    yy = total - xx - 2 * xy
    values = unbiased(xx, yy, xy, n, m)
    return float(values[0]), float(((values[1:] >= values[0]).sum() + 1) / (permutations + 1)), values[1:]


def mmd_tests(samples: DataFrame, permutations: int = 1000, alpha: float = 0.05, seed: int = 0, bandwidth: float | None = None) -> DataFrame:
    """``samples``: (test, current boolean, key, x array<double>), each side a bounded sample. One row per
    test; rows are put in the order of ``key`` first, so reruns agree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        side = [np.stack(pdf.loc[pdf["current"] == c, "x"].to_numpy()) if (pdf["current"] == c).any() else np.zeros((0, 1)) for c in (False, True)]
        if min(map(len, side)) < 2:
            return pd.DataFrame([[pdf["test"].iloc[0], None, None, len(side[0]), len(side[1]), permutations, None, None, None, None]], columns=[c.split()[0] for c in RESULT.split(", ")])
        h = median_bandwidth(side[0]) if bandwidth is None else bandwidth
        value, p, null = permutation_test(*side, h, permutations, seed)
        return pd.DataFrame([[pdf["test"].iloc[0], value, p, len(side[0]), len(side[1]), permutations, h, null.mean(), null.std(), p < alpha]], columns=[c.split()[0] for c in RESULT.split(", ")])

    return samples.groupBy("test").applyInPandas(run, RESULT)


def pair_samples(wide: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """One test for each pair of columns: 55 for eleven."""
    tests = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("test"), F.array(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("x")) for a, b in combinations(columns, 2)])
    return wide.select("current", F.col(key).alias("key"), F.inline(tests))


def localise(wide: DataFrame, columns: list[str], permutations: int = 200, key: str = "row_id") -> DataFrame:
    """Pairs of columns by falling MMD^2."""
    out = mmd_tests(pair_samples(wide, columns, key), permutations)
    return out.select(F.split("test", r"\|")[0].alias("column_x"), F.split("test", r"\|")[1].alias("column_y"), "mmd2", "pvalue").orderBy(F.desc("mmd2"), "column_x", "column_y")


def mmd2_blocks(rows: DataFrame, h: float, size: int = BLOCK_ROWS, seed: str = "mmd-block") -> DataFrame:
    """(mmd2, n, m, blocks): the statistic of tables of any size. ``rows`` (current boolean, key, x) are dealt by
    hash to blocks of about ``size`` rows, each block gives the unbiased statistic of its own pairs, and
    blocks are averaged: work grows with rows and not with pairs. Up to ``size`` rows there is one block,
    which is the statistic over all pairs.

    Vectors that are null or hold a null are left out; a block with fewer than two rows on a side counts
    its rows but gives no statistic; an empty table gives a null and zeros."""
    whole = rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    blocks = max(1, -(-whole.count() // size))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf.loc[pdf["current"] == c, "x"].to_list() for c in (False, True))
        value = None
        if min(len(x), len(y)) > 1:
            x, y = np.stack(x), np.stack(y)
            value = unbiased(rbf(x, x, h).sum(), rbf(y, y, h).sum(), rbf(x, y, h).sum(), len(x), len(y))
        return pd.DataFrame({"mmd2": [value], "n": [len(x)], "m": [len(y)]})

    block = F.floor(hash_uniform(seed, "key") * blocks).alias("block")
    per = whole.select(block, "current", "x").groupBy("block").applyInPandas(one, "mmd2 double, n long, m long")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.avg("mmd2").alias("mmd2"), zero("n"), zero("m"), F.count("mmd2").alias("blocks"))


def fit_context(reference: DataFrame, columns: list[str], seed: str, key: str = "row_id", rows: int = BANDWIDTH_ROWS) -> tuple[DataFrame, DataFrame, float]:
    """What later batches are tested against: the reference's ECDF of each column, a sample of at most
    ``rows`` reference rows as vectors of normal scores, and the sample's median bandwidth. Only
    that sample reaches the driver."""
    from .ecdf import fit_ecdf
    from .profile import to_long
    from .sampling import uniform_sample

    ecdf = fit_ecdf(to_long(reference, columns))
    sample = score_vectors(uniform_sample(reference, rows, seed, key), ecdf, columns, key)
    x = sample.orderBy("key").toPandas()["x"]
    return ecdf, sample, median_bandwidth(np.stack(x.to_numpy())) if len(x) else 1.0


def score_vectors(df: DataFrame, ecdf: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """(key, x): normal scores of ``columns`` against the reference's ECDF, in the order of ``columns``;
    rows with a null in one of them are left out."""
    from .ecdf import midrank, normal_score
    from .profile import to_long

    z = normal_score(midrank(to_long(df, columns, key), ecdf, key))
    per = z.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("_z")).where(F.size("_z") == len(columns))
    return per.select(F.col(key).alias("key"), F.array(*[F.col("_z")[c] for c in columns]).alias("x"))


def context_test(batch: DataFrame, context: tuple[DataFrame, DataFrame, float], columns: list[str], name: str, seed: str, key: str = "row_id", rows: int = BANDWIDTH_ROWS, permutations: int = 1000) -> DataFrame:
    """A batch against a fitted context: at most ``rows`` of its rows, drawn by hash."""
    from .sampling import uniform_sample

    ecdf, sample, h = context
    own = score_vectors(uniform_sample(batch, rows, seed, key), ecdf, columns, key)
    both = sample.withColumn("current", F.lit(False)).unionByName(own.withColumn("current", F.lit(True)))
    return mmd_tests(both.select(F.lit(name).alias("test"), "current", "key", "x"), permutations, bandwidth=h)


def self_aa(pool: DataFrame, n: int, repeats: int, permutations: int, seed: str, key: str, vec: str) -> DataFrame:
    """Both sides from one population: how often the test rejects. One group per repeat."""
    from .sampling import draws

    drawn = draws(pool.select(F.col(key).alias("key"), F.col(vec).alias("x")), [2 * n], repeats, seed, "key")
    u = hash_uniform(seed + ":side", F.col("repeat"), F.col("key"))
    return mmd_tests(drawn.select(F.concat(F.lit("aa-"), F.col("repeat").cast("string")).alias("test"), (u < 0.5).alias("current"), "key", "x"), permutations)


def floored_p(p: Column, permutations: int) -> Column:
    """The p-value as text; one that no permutation reached is a bound, 1 / (B + 1)."""
    floor = 1.0 / (permutations + 1)
    return F.when(p <= floor + 1e-12, F.concat(F.lit("<= "), F.format_number(F.lit(floor), 4))).otherwise(F.format_number(p, 4))
