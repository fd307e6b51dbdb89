"""Column functions that Spark lacks, built from its own expressions (no Python in the plan)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: str, *keys: Column | str) -> Column:
    """A uniform number in (0, 1) from 32 bits of an MD5 of seed and keys: the same on any partitioning,
    rerun or engine, unlike ``rand``. Never 0 or 1."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    joined = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def hash_digits(seed: str, *keys: Column | str) -> Column:
    """The eight hex digits that ``hash_uniform`` makes its number of; in the order of text they are in the order of those numbers."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])), 1, 8)


def hash_below(share: float, seed: str, *keys: Column | str) -> Column:
    """``hash_uniform(seed, *keys) < share``, for every row of a large table: no digits are made into numbers."""
    low, high = 0, 1 << 32  # the least integer whose number is not below
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if (mid + 0.5) / 4294967296.0 < share else (low, mid)
    return F.lit(True) if low == 1 << 32 else hash_digits(seed, *keys) < F.lit(f"{low:08x}")


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def salted_id(col: Column, salt: str) -> Column:
    """The first 16 hex digits of SHA-256 over salt and id: stable within a salt, useless without it."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), col.cast("string")), 256), 1, 16)


#: Acklam's rational approximation of the inverse normal distribution function
#: (relative error below 1.2e-9), for the centre and the tails.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_TAIL = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(u: Column) -> Column:
    """The normal quantile of u in (0, 1); null outside."""
    tail = lambda q: _horner(q, PPF_C) / (_horner(q, PPF_D) * q + 1.0)
    low, high = F.sqrt(-2.0 * F.log(u)), F.sqrt(-2.0 * F.log(1.0 - u))
    q = u - 0.5
    r = q * q
    middle = _horner(r, PPF_A) * q / (_horner(r, PPF_B) * r + 1.0)
    return F.when((u > 0) & (u < PPF_TAIL), tail(low)).when((u > 1 - PPF_TAIL) & (u < 1), -tail(high)).when((u >= PPF_TAIL) & (u <= 1 - PPF_TAIL), middle)


def kolmogorov_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p of a two-sample KS statistic, with the usual small-sample correction of
    lambda; clipped to [0, 1]. The leading term decides beyond lambda of about 1."""
    en = n.cast("double") * m.cast("double") / (n + m).cast("double")
    root = F.sqrt(en)
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


#: The 97.5 % normal quantile.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval of k successes in n, inside [0, 1] and around k / n;
    null where n is 0 (a rate of nothing is unknown, not NaN)."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    denom = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / denom
    half = z / denom * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n))
    low = F.greatest(F.lit(0.0), F.least(centre - half, p))
    high = F.least(F.lit(1.0), F.greatest(centre + half, p))
    return F.when(n > 0, low), F.when(n > 0, high)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null on a zero denominator."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def holds(c: Column) -> Column:
    """A predicate in which unknown counts as false, as masks do in a dataframe library."""
    return F.coalesce(c, F.lit(False))


def psi_null_bias(n: Column, m: Column, bins: Column) -> Column:
    """Expected index of two samples of one population: (bins - 1)(1/n + 1/m)."""
    return (bins - 1) * (1.0 / n + 1.0 / m)


def relative_path(path: Column, root: str) -> Column:
    """A path with forward slashes, single ones and without ``./``, below ``root`` if it lies there."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(?:\./)+", "/"), "/{2,}", "/")
    flat = F.regexp_replace(flat, r"^(?:\./)+", "")
    top = re.sub("/{2,}", "/", root.replace("\\", "/")).rstrip("/") + "/"
    return F.when(F.startswith(flat, F.lit(top)), F.substring(flat, len(top) + 1, 1 << 30)).otherwise(flat)


def day_stamp(ts: Column) -> Column:
    """The day as yyyyMMdd, as batch names bear it."""
    return F.date_format(ts, "yyyyMMdd")


def whole_second(ts: Column) -> Column:
    """The time cut to its second, as reports show it."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss")


def copula_start(rho_s: float) -> float:
    """Pearson correlation of the Gaussian copula with Spearman correlation ``rho_s``."""
    return 2.0 * math.sin(math.pi * rho_s / 6.0)
