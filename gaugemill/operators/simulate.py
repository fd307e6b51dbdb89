"""Drift simulation: lagged weights, inflation, stress on labels, inverted dependence.

A simulated month draws rows with weights that grow with the month, inflates nominal amounts, and flips
labels one way; arms switch single mechanisms on. All randomness is hashed from seed and row id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import copula_start, gumbel, hash_uniform, norm_ppf
from ..sources.tables import DEBT_RATIO, INCOME, INCOME_MISSING, TARGET
from .metrics import batch_metrics
from .profile import spearman
from .rules import c
from .sampling import ordinal_rank


@dataclass(frozen=True)
class SimulationConfig:
    """Fixed values of the published run; toggles choose the mechanisms."""

    seed: str = "20260921"
    n_months: int = 6
    batch_rows: int = 7368
    b_util: float = 0.90
    b_age: float = 0.45
    b_d30: float = 0.70
    b_d60: float = 0.60
    b_d90: float = 0.60
    lag_60: int = 2
    lag_90: int = 3
    inflation: float = 0.10
    stress_extra: float = 0.03
    composition: bool = True
    nominal: bool = True
    stress: bool = True

    def only(self, mechanism: str) -> SimulationConfig:
        return replace(self, **{m: m == mechanism for m in ("composition", "nominal", "stress")})


ARMS = ("full", "composition_only", "nominal_only", "stress_only")


def arm(config: SimulationConfig, name: str) -> SimulationConfig:
    return config if name == "full" else config.only(name.removesuffix("_only"))


def intensity(month: int, n_months: int) -> float:
    return month / n_months


def lagged(month: int, lag: int, n_months: int) -> float:
    return 0.0 if month <= lag else (month - lag) / (n_months - lag)


def composition_log_weight(month: int, cfg: SimulationConfig) -> Column:
    """Needs normal scores z_util, z_age, z_d30, z_d60, z_d90."""
    n = cfg.n_months
    s = intensity(month, n)
    return s * (cfg.b_util * c("z_util") - cfg.b_age * c("z_age") + cfg.b_d30 * c("z_d30") + cfg.b_d60 * lagged(month, cfg.lag_60, n) * c("z_d60") + cfg.b_d90 * lagged(month, cfg.lag_90, n) * c("z_d90"))


def draw_batch(pool: DataFrame, month: int, cfg: SimulationConfig, key: str = "row_id") -> DataFrame:
    """Month 0, or an arm without composition: uniform; else weighted, both without replacement."""
    u = hash_uniform(f"{cfg.seed}:draw:{month}", key)
    weight = composition_log_weight(month, cfg) if cfg.composition and month else F.lit(0.0)
    return pool.orderBy(F.desc(weight + gumbel(u)), key).limit(cfg.batch_rows)


def inflate(df: DataFrame, factor: float | Column) -> DataFrame:
    """Income up and debt ratio down by ``factor`` where income is known; ``inflated`` marks the rows."""
    known = c(INCOME_MISSING) == 0
    return df.withColumn(INCOME, F.when(known, c(INCOME) * factor).otherwise(c(INCOME))).withColumn(DEBT_RATIO, F.when(known, c(DEBT_RATIO) / factor).otherwise(c(DEBT_RATIO))).withColumn("inflated", known.cast("int"))


def stress_scale(df: DataFrame, u: Column, extra: float) -> DataFrame:
    """One row: c = extra * rows / sum of u over negatives; 0 if that sum is 0."""
    total = F.sum(F.when(c(TARGET) == "0", u))
    return df.agg(F.when(total > 0, F.lit(extra) * F.count(F.lit(1)) / total).otherwise(F.lit(0.0)).alias("stress_c"))


def stress_labels(df: DataFrame, u: str, s: float, extra: float, seed: str, key: str = "row_id") -> DataFrame:
    """Flips negatives to positive with probability clip(c s u, 0, 1); never back. ``flipped`` marks them."""
    scaled = df.crossJoin(F.broadcast(stress_scale(df, c(u), extra)))  # one row
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("stress_c") * s * c(u)))
    flip = (c(TARGET) == "0") & (hash_uniform(seed, key) < p)
    return scaled.withColumn("flipped", F.coalesce(flip, F.lit(False)).cast("int")).withColumn(TARGET, F.when(F.col("flipped") == 1, "1").otherwise(c(TARGET))).drop("stress_c")


def change_batch(batch: DataFrame, month: int, cfg: SimulationConfig, key: str = "row_id") -> DataFrame:
    """Inflates a drawn batch and flips its labels as the month and the arm say; adds ``month``."""
    out, s = batch, intensity(month, cfg.n_months)
    out = inflate(out, 1.0 + cfg.inflation * s) if cfg.nominal and month else out.withColumn("inflated", F.lit(0))
    out = stress_labels(out, "u_util", s, cfg.stress_extra, f"{cfg.seed}:flip:{month}", key) if cfg.stress and month else out.withColumn("flipped", F.lit(0))
    return out.withColumn("month", F.lit(month))


def simulate_month(pool: DataFrame, month: int, cfg: SimulationConfig, key: str = "row_id") -> DataFrame:
    """``pool`` has z scores and u_util (mid-rank of utilisation); adds ``month``."""
    return change_batch(draw_batch(pool, month, cfg, key), month, cfg, key)


def simulate(pool: DataFrame, cfg: SimulationConfig, key: str = "row_id") -> DataFrame:
    """All months of one arm in one plan."""
    out = simulate_month(pool, 0, cfg, key)
    for m in range(1, cfg.n_months + 1):
        out = out.unionByName(simulate_month(pool, m, cfg, key))
    return out


def simulate_arms(pool: DataFrame, cfg: SimulationConfig, arms=ARMS, key: str = "row_id") -> DataFrame:
    """The ablation: every arm with the same seed, tagged ``scenario``."""
    out = None
    for name in arms:
        part = simulate(pool, arm(cfg, name), key).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def draw_arms(pool: DataFrame, cfg: SimulationConfig, arms=ARMS, key: str = "row_id") -> DataFrame:
    """The batches that the arms draw, each once: arms with the same seed draw the same rows of a month if both weigh them or
    neither does. ``drawn_month`` and ``weighed`` name the batch."""
    out = None
    for month, weighed in sorted({(m, bool(arm(cfg, name).composition and m)) for name in arms for m in range(cfg.n_months + 1)}):
        part = draw_batch(pool, month, replace(cfg, composition=weighed), key).withColumn("drawn_month", F.lit(month)).withColumn("weighed", F.lit(weighed))
        out = part if out is None else out.unionByName(part)
    return out


def simulate_drawn(drawn: DataFrame, cfg: SimulationConfig, arms=ARMS, key: str = "row_id") -> DataFrame:
    """The rows of ``simulate_arms`` from those of ``draw_arms``, which should be a table: each month of each arm reads it."""
    out = None
    for name in arms:
        own = arm(cfg, name)
        for m in range(cfg.n_months + 1):
            batch = drawn.where((F.col("drawn_month") == m) & (F.col("weighed") == F.lit(bool(own.composition and m)))).drop("drawn_month", "weighed")
            part = change_batch(batch, m, own, key).withColumn("scenario", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out


def month_metrics(scored: DataFrame) -> DataFrame:
    return batch_metrics(scored, "scenario", "month")


# Dependence inversion

#: The range of rho and the most steps of the bisection.
RHO_MOST, BISECTION_STEPS = 0.999, 40


def ranked_values(df: DataFrame, value: str, key: str = "row_id") -> DataFrame:
    """``_k, _v``: the k-th smallest value, ties by ``key``."""
    return ordinal_rank(df.select(c(key), c(value)), value, key, "_k").select("_k", c(value).alias("_v"))


def reorder_to_latent(df: DataFrame, value: str, latent: str, key: str = "row_id", values: DataFrame | None = None) -> DataFrame:
    """Gives the k-th smallest value to the row with the k-th smallest latent: same marginal, new order. ``values`` may
    hold ``ranked_values`` of it, for callers that ask again with another latent."""
    ranked = ordinal_rank(df, latent, key, "_k")
    return ranked.join(ranked_values(df, value, key) if values is None else values, "_k").withColumn(value, F.col("_v")).drop("_k", "_v")


def ordinal_uniform(df: DataFrame, column: str, name: str, key: str = "row_id") -> DataFrame:
    """(rank + 0.5) / n with ties by ``key``."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return ordinal_rank(df, column, key, "_k").crossJoin(F.broadcast(total)).withColumn(name, (F.col("_k") - 0.5) / F.col("_all")).drop("_k", "_all")


def spearman_of(df: DataFrame, x: str, y: str) -> float | None:
    return spearman(df, [x, y]).first().rho


def invert_dependence(df: DataFrame, x: str, y: str, seed: str, tolerance: float = 0.02, steps: int = BISECTION_STEPS, key: str = "row_id") -> tuple[DataFrame, float, float]:
    """Turns the Spearman correlation of (x, y) into its opposite without touching either marginal.

    y is dealt anew along latent = rho z_x + sqrt(1 - rho^2) noise; rho starts at the Gaussian copula's
    value for the goal and is bisected until the measured correlation is within ``tolerance``. Returns
    the batch, the correlation before and after. Each step is one plan; ranks are cached between them.
    """
    before = spearman_of(df, x, y) or 0.0
    goal, low, high = -before, -RHO_MOST, RHO_MOST
    rho = max(low, min(high, copula_start(goal)))
    base = ordinal_uniform(df, x, "_ux", key).withColumn("_zx", norm_ppf(F.col("_ux"))).withColumn("_e", norm_ppf(hash_uniform(seed, key))).persist()
    values = ranked_values(df, y, key).persist()
    try:
        for _ in range(steps):
            out = reorder_to_latent(base.withColumn("_latent", rho * F.col("_zx") + math.sqrt(1 - rho * rho) * F.col("_e")), y, "_latent", key, values)
            after = spearman_of(out, x, y) or 0.0
            if abs(after - goal) <= tolerance:
                break
            low, high = (rho, high) if after < goal else (low, rho)
            rho = (low + high) / 2
    finally:
        base.unpersist()
        values.unpersist()
    return out.select(*[c(n) for n in df.columns]), before, after


def multisets_match(a: DataFrame, b: DataFrame, columns) -> DataFrame:
    """(column, equal): whether both sides hold the same values as often."""
    long = lambda d: d.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns])))
    both = long(a).withColumn("_d", F.lit(1)).unionByName(long(b).withColumn("_d", F.lit(-1)))
    return both.groupBy("column", "value").agg(F.sum("_d").alias("d")).groupBy("column").agg((F.max(F.abs("d")) == 0).alias("equal"))
