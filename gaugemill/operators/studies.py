"""Studies around drift: sensitivity of tests and model, null thresholds, score drift, small report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import kolmogorov_pvalue
from ..sources.tables import CONTINUOUS, DEBT_RATIO, INCOME, TARGET
from .ecdf import ks_of_located, ks_two_sample
from .metrics import batch_metrics
from .profile import to_long
from .psi import FEW_VALUES, bin_of, bins_of_counted, edges_of_running, psi, psi_of_binned
from .ranks import gathered, looked_up_parts, running
from .rules import c
from .sampling import draws, uniform_sample
from .simulate import inflate

#: The grid of the sensitivity sweep.
LEVELS, SIZES, PROBED = (0.01, 0.02, 0.05, 0.10), (1000, 7000, 44_000), (DEBT_RATIO, INCOME)


def sensitivity(reference: DataFrame, holdout: DataFrame, score: Column, columns=PROBED, levels=LEVELS, sizes=SIZES, seed: str = "sensitivity", key: str = "row_id") -> DataFrame:
    """One row per (level, n, column): KS and PSI of an inflated batch against the reference, beside the
    shift of the mean score and of the AUC against the same batch as it was.

    A batch of each size is drawn once from ``holdout`` (all of it if it is smaller); every row of it is
    read at each level, level 0 being the batch itself, so the whole grid is one plan. The batches, which have a fixed size, are
    shuffled whole: all that reads them shares that shuffle."""
    batch = None
    for n in sizes:
        part = uniform_sample(holdout, n, f"{seed}:{n}", key).withColumn("n", F.lit(n))
        batch = part if batch is None else batch.unionByName(part)
    batch = batch.repartition(key)
    batch = batch.select(F.inline(F.array(F.struct(*[F.col(f"`{x}`") for x in batch.columns]))))
    grid = inflate(batch.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in (0.0, *levels)]))), 1.0 + F.col("level"))
    scored = grid.select("n", "level", score.alias("p"), F.when(c(TARGET) == "1", 1).otherwise(0).alias("y"))
    moved = batch_metrics(scored, "n", "level").select("n", "level", "mean_predicted", "auc")
    still = moved.where("level = 0").select("n", F.col("mean_predicted").alias("_p"), F.col("auc").alias("_auc"))
    shifts = moved.join(still, "n").select("n", "level", (F.col("mean_predicted") - F.col("_p")).alias("mean_prediction_shift"), (F.col("auc") - F.col("_auc")).alias("auc_delta"))
    base, long = to_long(reference, columns), to_long(grid.where("level > 0"), columns, "n", "level")
    tests = ks_two_sample(base, long, "n", "level").join(psi(base, long, "n", "level"), ["n", "level", "feature"])
    return tests.join(shifts, ["n", "level"]).select("level", "n", F.col("feature").alias("column"), F.col("ks").alias("ks_statistic"), F.col("pvalue").alias("ks_pvalue"), "psi", "mean_prediction_shift", "auc_delta")


#: The grid of the false-alarm calibration.
AA_SIZES, AA_REPEATS = (250, 500, 1000, 2000, 5000, 7000, 20_000), 200


def false_alarms(reference: DataFrame, holdout: DataFrame, features: list[str], sizes=AA_SIZES, repeats: int = AA_REPEATS, seed: str = "aa", key: str = "k") -> DataFrame:
    """(n, repeat, feature, ks_statistic, ks_pvalue, psi): draws from ``holdout``, which has not drifted, against ``reference``.
    Both are wide: ``features``, and ``key`` on the holdout."""
    columns = [F.col(f"`{f}`") for f in features]
    none = F.lit(None).cast(holdout.schema[key].dataType).alias(key)
    both = reference.select(F.lit(True).alias("reference"), none, *columns).unionByName(holdout.select(F.lit(False).alias("reference"), key, *columns))
    return false_alarms_of_split(both, features, sizes, repeats, seed, key)


def false_alarms_of_split(rows: DataFrame, features: list[str], sizes=AA_SIZES, repeats: int = AA_REPEATS, seed: str = "aa", key: str = "k", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same of one table (``reference`` boolean, ``key``, ``features``), whose values are counted in one pass.

    Each distinct value is put once into the order of the reference's; a draw looks its rows up there, so that it is measured from its
    own rows alone. Rows of frequent values are counted before they are shuffled. Null values are in no draw's counts. ``keep`` writes
    the tables of distinct values and that of edges and gives what was written, for their many readers."""
    keep = keep or (lambda df: gathered(df, "feature"))
    # Numbers stand for features while there is a row for each draw.
    stack = F.expr(f"stack({len(features)}, {', '.join(f'{i}, `{f}`' for i, f in enumerate(features))}) AS (feature, value)")
    named = lambda df: df.withColumn("feature", F.get(F.array(*map(F.lit, features)), F.col("feature")))
    per = rows.select("reference", stack).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count_if("reference").alias("_n"), F.count_if(~F.col("reference")).alias("hits"))
    per = keep(per.withColumn("_m", F.when(F.isnan("value"), 0).otherwise(F.col("_n"))))
    run = keep(running(per, "feature", sums=("_n", "_m")))
    numbers = run.where("_m > 0").select("feature", "value", F.col("_m").alias("_n"), F.col("_m_before").alias("_n_before"), F.col("_m_all").alias("_n_all"))
    edges = keep(edges_of_running(numbers))
    lines = run.where("hits > 0 AND _n_all > 0").join(F.broadcast(edges), "feature")
    lines = lines.select("feature", "value", F.col("_n_before").alias("below"), (F.col("_n_before") + F.col("_n")).alias("upto"), F.col("_n_all").alias("total"), bin_of(F.col("value"), F.col("interior")).alias("bin"), "hits")
    drawn = draws(rows.where("NOT reference").select(key, *[F.col(f"`{f}`") for f in features]), sizes, repeats, seed, key)
    hot, cold = looked_up_parts(drawn.select("n", "repeat", stack).where("value IS NOT NULL"), lines, "hits")
    place = ["n", "repeat", "feature", "below", "upto", "total", "bin"]
    at = hot.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).unionByName(cold.select(*place, F.lit(1).cast("long").alias("c")))
    # One exchange: all that follows keeps a draw's feature together.
    by = ["n", "repeat", "feature"]
    at = at.repartition(*by).groupBy(*place).agg(F.sum("c").alias("c"))
    bin_counts = F.array(*[F.sum(F.when(F.col("bin") == i, F.col("c"))) for i in range(FEW_VALUES + 1)])  # more than there are
    tests = gathered(ks_of_located(at, "n", "repeat", also=(bin_counts.alias("bins"),)), "feature", "n", "repeat")  # in another order, or the exchange would be left out
    ks = tests.select(*by, F.col("ks").alias("ks_statistic"), kolmogorov_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_cur")).alias("ks_pvalue"))
    bins = tests.select(*by, F.posexplode("bins").alias("bin", "_n")).where("_n IS NOT NULL")
    return named(ks.join(psi_of_binned(bins_of_counted(numbers, edges), bins, edges, "n", "repeat"), by))


def ks_continuous(reference: DataFrame, current: DataFrame, columns=CONTINUOUS) -> DataFrame:
    """KS where it means something: on continuous columns, not on counts with few values."""
    return ks_two_sample(to_long(reference, columns), to_long(current, columns))


def prediction_drift(reference: DataFrame, current: DataFrame, *by: str, score: str = "p") -> DataFrame:
    """(by..., psi): stability index of the score itself, on bins of the reference's scores."""
    long = lambda df, *keys: df.select(*keys, F.lit(score).alias("feature"), F.col(score).alias("value"))
    return psi(long(reference), long(current, *by), *by).drop("feature")


def null_thresholds(scored: DataFrame, n: int = 7000, repeats: int = 500, seed: str = "null", key: str = "row_id", gap_at: float = 0.005, auc_at: float = 0.01) -> DataFrame:
    """One row: the low percentiles of calibration gap and AUC over ``repeats`` draws of ``n`` rows without
    any drift. Beyond them a batch is rarer than chance."""
    per = batch_metrics(draws(scored.select(key, "y", "p"), [n], repeats, seed, key), "repeat")
    return per.agg(F.count(F.lit(1)).alias("draws"), F.percentile("calibration_gap", gap_at).alias("gap_threshold"), F.percentile("auc", auc_at).alias("auc_threshold"))


def mean_matrix(df: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Group means, one column per value of ``column``."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def rank_of_pair(pairs: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Where the pair (x, y), in either order, stands when pairs are sorted by falling ``by``; 1 is first."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by), "x", "y"))  # one row per pair of columns
    same = ((F.col("x") == x) & (F.col("y") == y)) | ((F.col("x") == y) & (F.col("y") == x))
    return pairs.withColumn("place", place).where(same).select("x", "y", by, "place")


def numeric_frame(df: DataFrame) -> DataFrame:
    """The numeric columns alone, as doubles."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) for f in df.schema if isinstance(f.dataType, T.NumericType)])


def stable_sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """A uniform sample of n rows in the order of ``key``, which it does not disturb."""
    return uniform_sample(df, n, seed, key).orderBy(key)


def latest_by_name(df: DataFrame, name: str) -> DataFrame:
    """The rows that bear the greatest name, as dated file and batch names sort by time."""
    last = df.agg(F.max(name).alias("_last"))
    return df.join(F.broadcast(last), F.col(name) == F.col("_last")).drop("_last")  # one row


def highest(drift: DataFrame, **labels: str) -> DataFrame:
    """One row: the largest index among the series that bear all ``labels``; null if there is none."""
    for k, v in labels.items():
        drift = drift.where(F.col(k) == v)
    return drift.agg(F.max("psi").alias("psi"))
