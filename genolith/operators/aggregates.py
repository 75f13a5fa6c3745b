"""Aggregates whose details differ between SQL engines, spelled out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_and_spread(columns: Sequence[str]) -> list[Column]:
    """avg_x and std_x (of the population) for each column."""
    return [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("avg", F.avg), ("std", F.stddev_pop))]


def column_stat(df: DataFrame, columns: Sequence[str], where: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """type, average, minimum, maximum, std, count, sum: a row for each column (and group), in one pass. Sums are taken in decimals, so that their order does not matter."""
    df = df.where(where) if where else df
    stacked = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*")
    return stacked.groupBy(*by, "type").agg(F.avg("v").alias("average"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.stddev_pop("v").alias("std"), F.count("v").alias("count"), F.sum(F.col("v").cast("decimal(28,10)")).cast("double").alias("sum"))


def ratio_of_means(a: Column, b: Column) -> Column:
    """avg(a) / avg(b), null where that is a division by 0."""
    return F.try_divide(F.avg(a), F.avg(b))


def mean_of_ratios(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.avg(F.try_divide(a, b) * scale)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def value_range(value: Column) -> Column:
    return F.max(value) - F.min(value)


def log2_distance(pi: Column) -> Column:
    """-0.75 log2(1 - 4/3 pi); null where undefined."""
    inner = 1 - F.lit(4.0) / 3 * pi
    return F.when(inner > 0, -0.75 * F.log2(inner))


def jukes_cantor(pi: Column) -> Column:
    """-0.75 ln(1 - 4/3 pi); null where undefined."""
    inner = 1 - F.lit(4.0) / 3 * pi
    return F.when(inner > 0, -0.75 * F.log(inner))


def line_fit(y: Column, x: Column) -> list[Column]:
    """r2, intercept, slope of y on x."""
    return [F.regr_r2(y, x).alias("r2"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope")]


def paired_t(difference: Column) -> list[Column]:
    """pairs, mean, t of paired differences; t is null for two pairs or fewer, or no spread."""
    n, spread = F.count(difference), F.stddev_samp(difference)
    return [n.alias("pairs"), F.avg(difference).alias("mean"), F.when(n > 2, F.try_divide(F.avg(difference) * F.sqrt(n), spread)).alias("t")]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def student_upper_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def line_p_value(r2: float | None, n: int) -> float | None:
    """p of the F test of a line; null for two points or fewer."""
    if r2 is None or n <= 2:
        return None
    return 0.0 if r2 >= 1 else f_upper_tail(r2 / (1 - r2) * (n - 2), 1, n - 2)
