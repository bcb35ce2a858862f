"""Operators on dense count series: means, combination, smoothing, shifts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_day(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("day")


def gathered(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all parts, dealt by `_dealt`, a hash of the keys; a column that a part lacks is null there.

    Windows and groups name `_dealt` before the keys. Where they don't, Spark 4.1 takes a union of parts that are dealt
    by keys for dealt by keys too, but adds the parts' partitions one after the other if it reuses an exchange below them
    (spark.sql.unionOutputPartitioning), so that rows of a key don't meet.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("_dealt", F.xxhash64(*keys)).repartition("_dealt")


def pooled_mean(series: DataFrame, value: str = "incidence") -> DataFrame:
    return series.agg(F.avg(value).alias("mean"))


def mean_of_means(series: DataFrame, values: dict[str, str], keys: list[str]) -> DataFrame:
    """One row: for each output name the mean over series of that column's mean, and their total."""
    means = series.groupBy(*keys).agg(*(F.avg(c).alias(n) for n, c in values.items()))
    out = means.agg(*(F.avg(n).alias(n) for n in values))
    return out.withColumn("total", sum((F.col(n) for n in values), F.lit(0.0)))


def combine(true: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Both series on the same rows; rows that either lacks raise an error when they are read."""
    joined = true.join(background, [*keys, "day"], "full_outer")
    both = F.col("incidence").isNotNull() & F.col("noise").isNotNull()
    return joined.withColumn("total", F.when(both, F.col("incidence") + F.col("noise")).otherwise(F.raise_error(F.lit("series differ in number or length"))))


def unmatched(true: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """How many (series, day) rows stand on one side only."""
    joined = true.join(background, [*keys, "day"], "full_outer")
    return joined.agg(F.count_if(F.col("incidence").isNull() | F.col("noise").isNull()).alias("n_unmatched"))


def trailing_mean(value: Column, window: int, keys: list[str]) -> Column:
    """Mean of the last `window` days, fewer at the start; a window of 0 is the value itself."""
    return F.avg(value).over(by_day(keys).rowsBetween(-(window - 1), 0)) if window > 0 else value.cast("double")


def shifted(value: Column, steps: int, keys: list[str]) -> Column:
    """Later by steps > 0, earlier by steps < 0, filled with 0."""
    w = by_day(keys)
    return F.lag(value, steps, 0).over(w) if steps > 0 else F.lead(value, -steps, 0).over(w) if steps < 0 else value


def with_alert_inputs(positives: DataFrame, keys: list[str], window: int = 7, value: str = "test_pos") -> DataFrame:
    """Adds test_pos_ma, the trailing mean that averaging alert methods compare."""
    return positives.withColumn("test_pos_ma", trailing_mean(F.col(value), window, keys))


def compared(method: Column) -> Column:
    """What a method compares with its threshold: the day's count, its mean, or whichever is larger."""
    return F.when(method == "DailyThreshold", F.col("test_pos").cast("double")).when(method == "MovingAverage", F.col("test_pos_ma")).when(
        method == "DailyThresholdMovingAverage", F.greatest(F.col("test_pos").cast("double"), F.col("test_pos_ma"))
    )


def in_years(df: DataFrame, first: float, last: float) -> DataFrame:
    """Values on days of the window, or intervals (lo, hi) wholly inside it; years have 365 days."""
    a, b = max(1, int(first * 365)), int(last * 365)
    return df.where((F.col("lo") >= a) & (F.col("hi") <= b)) if "lo" in df.columns else df.where(F.col("day").between(a, b))


#: Expected hits from which on a draw is made by transformed rejection, below by inversion.
LEAST_HITS = 10.0


def uniforms(seed: np.ndarray) -> np.ndarray:
    """A number from [0, 1) for each 64-bit seed."""
    x = seed.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _uniform(seed: np.ndarray, number: int) -> np.ndarray:
    """The number-th uniform of each seed."""
    return uniforms(seed.astype(np.int64).view(np.uint64) ^ np.uint64(number * 0xD1342543DE82EF95 % (1 << 64)))


#: log k! less its leading terms (k + 1/2) log(k + 1) - (k + 1) + log(2 pi) / 2, for small k.
_tail = np.array([math.lgamma(k + 1) - (k + 0.5) * math.log(k + 1) + (k + 1) - 0.5 * math.log(2 * math.pi) for k in range(10)])


def _factorial_tail(k: np.ndarray) -> np.ndarray:
    square = (k + 1.0) ** 2
    return np.where(k < 10, _tail[np.clip(k, 0, 9).astype(np.int64)], (1 / 12 - (1 / 360 - 1 / (1260 * square)) / square) / (k + 1.0))


def _rejected(seed: np.ndarray, a: np.ndarray, b: np.ndarray, centre: np.ndarray, sure: np.ndarray, most: np.ndarray, accepts) -> np.ndarray:
    """Draws by transformed rejection (Hoermann 1993): a pair of uniforms an attempt, until each row has one accepted.

    sure is the chance below which an attempt near the centre is accepted at once; accepts(rows, k, v, us) decides on others.
    """
    out, open_, turn = np.zeros(len(seed), np.int64), np.arange(len(seed)), 0
    while len(open_):
        u, v = _uniform(seed[open_], 2 * turn) - 0.5, _uniform(seed[open_], 2 * turn + 1)
        us = np.maximum(0.5 - np.abs(u), 1e-12)
        k = np.floor((2 * a[open_] / us + b[open_]) * u + centre[open_])
        good = (us >= 0.07) & (v <= sure[open_])
        tried = np.flatnonzero(~good & (k >= 0) & (k <= most[open_]))
        good[tried] = accepts(open_[tried], k[tried], np.maximum(v[tried], 1e-300), us[tried])
        out[open_[good]] = k[good].astype(np.int64)
        open_, turn = open_[~good], turn + 1
    return out


def _inverted(u: np.ndarray, chance: np.ndarray, ratio) -> np.ndarray:
    """The least k whose cumulative chance exceeds u, for all elements at once; ratio(k, at) is chance k over chance k - 1."""
    out, at, k = np.zeros(len(u), np.int64), np.arange(len(u)), 0
    total = chance.copy()
    while True:
        open_ = (u[at] >= total) & (chance > 0)
        at, chance, total, k = at[open_], chance[open_], total[open_], k + 1
        if not len(at):
            return out
        out[at] = k
        chance = chance * ratio(k, at)
        total = total + chance


def binomial(seed: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Binomial(n, p) draws; memory and time don't depend on n."""
    n, p = np.maximum(np.nan_to_num(n), 0).astype(np.int64), np.clip(np.nan_to_num(p), 0.0, 1.0)
    q, out = np.minimum(p, 1 - p), np.zeros(len(n), np.int64)
    large = n * q >= LEAST_HITS
    few = np.flatnonzero(~large)
    trials, chance = n[few], q[few]
    hits = _inverted(_uniform(seed[few], 0), np.exp(trials * np.log1p(-chance)), lambda k, at: (trials[at] - k + 1) / k * chance[at] / (1 - chance[at]))
    out[few] = np.minimum(hits, trials)
    rows = np.flatnonzero(large)
    t, c = n[rows].astype(float), q[rows]
    spread, odds, mode = np.sqrt(t * c * (1 - c)), c / (1 - c), np.floor((t + 1) * c)
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * c
    scale = (2.83 + 5.1 / b) * spread

    def accepts(at: np.ndarray, k: np.ndarray, v: np.ndarray, us: np.ndarray) -> np.ndarray:
        m, n_, r = mode[at], t[at], odds[at]
        chance = (m + 0.5) * np.log((m + 1) / (r * (n_ - m + 1))) + (n_ + 1) * np.log((n_ - m + 1) / (n_ - k + 1)) + (k + 0.5) * np.log(r * (n_ - k + 1) / (k + 1))
        chance += _factorial_tail(m) + _factorial_tail(n_ - m) - _factorial_tail(k) - _factorial_tail(n_ - k)
        return np.log(v * scale[at] / (a[at] / us**2 + b[at])) <= chance

    out[rows] = _rejected(seed[rows], a, b, t * c + 0.5, 0.92 - 4.2 / b, t, accepts)
    return np.where(p > 0.5, n - out, out)


def poisson(seed: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson(mean) draws; memory and time don't depend on the mean."""
    mean, out = np.maximum(np.nan_to_num(mean), 0.0), np.zeros(len(mean), np.int64)
    few, rows = np.flatnonzero(mean < LEAST_HITS), np.flatnonzero(mean >= LEAST_HITS)
    out[few] = _inverted(_uniform(seed[few], 0), np.exp(-mean[few]), lambda k, at: mean[few][at] / k)
    m = mean[rows]
    b = 0.931 + 2.53 * np.sqrt(m)
    a = -0.059 + 0.02483 * b

    def accepts(at: np.ndarray, k: np.ndarray, v: np.ndarray, us: np.ndarray) -> np.ndarray:
        chance = (k + 1 - m[at]) + k * np.log(m[at] / (k + 1)) - 0.5 * np.log(2 * math.pi * (k + 1)) - _factorial_tail(k)
        return np.log(v * (1.1239 + 1.1328 / (b[at] - 3.4)) / (a[at] / us**2 + b[at])) <= chance

    out[rows] = _rejected(seed[rows], a, b, m + 0.43, 0.9277 - 3.6224 / (b - 2), np.full(len(rows), np.inf), accepts)
    return out


def static_background(series: DataFrame, level: float, seed: int, keys: list[str]) -> DataFrame:
    """Adds noise: an independent Poisson(level * mean incidence) draw for each series and day.

    A draw's seed is a hash of series and day, so draws don't depend on partitions or on retries.
    """

    @F.pandas_udf("long")
    def drawn(seed: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(poisson(seed.to_numpy(), mean.to_numpy()))

    mean = series.agg((F.avg("incidence") * level).alias("_mean"))  # one row
    rows = series.crossJoin(F.broadcast(mean))
    return rows.withColumn("noise", drawn(F.xxhash64(F.lit(seed), *map(F.col, keys), F.col("day")), F.coalesce("_mean", F.lit(0.0)))).drop("_mean")
