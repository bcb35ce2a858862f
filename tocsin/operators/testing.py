"""From counts to test positives: thinning by testing rate, sensitivity, specificity and reporting lag."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.operators.series import binomial, by_day


class TestSpec(NamedTuple):
    __test__ = False
    sensitivity: float
    specificity: float
    test_lag: int


TEST_KEYS = ["percent_tested", "sensitivity", "specificity", "test_lag"]


def expected(count: Column, p: Column) -> Column:
    """count * p, halves to even."""
    return F.bround(count * p).cast("long")


def test_positives(true: Column, noise: Column, rate: float, test: TestSpec) -> Column:
    """A day's expected test positives of one test, without its reporting lag."""
    part = lambda count, p: expected(expected(count, F.lit(float(rate))), F.lit(float(p)))
    return part(true, test.sensitivity) + part(noise, 1 - test.specificity)


test_positives.__test__ = False


def reported(value: Column, lags: list[int], keys: list[str]) -> Column:
    """value on the day its result comes, by the row's test_lag: 0 before, dropped beyond the end. All lags share one window."""
    w = by_day([*keys, *TEST_KEYS])
    out = F.lit(None).cast("long")
    for k in sorted(set(lags), reverse=True):
        out = F.when(F.col("test_lag") == k, F.lag(value, k, 0).over(w) if k else value).otherwise(out)
    return out


def specified(series: DataFrame, rates: list[float], tests: list[TestSpec]) -> DataFrame:
    """Every series row for every testing rate and test; both lists are small dimensions."""
    grid = F.array(*(F.struct(F.lit(float(r)).alias("percent_tested"), F.lit(float(t.sensitivity)).alias("sensitivity"), F.lit(float(t.specificity)).alias("specificity"), F.lit(t.test_lag).alias("test_lag")) for r in rates for t in tests))
    return series.select("*", F.explode(grid).alias("_t")).select(*series.columns, "_t.*")


def expected_positives(series: DataFrame, rates: list[float], tests: list[TestSpec], keys: list[str]) -> DataFrame:
    """(keys, TEST_KEYS, day, incidence, tested..., true_pos, false_pos, test_pos) with rounded expectations instead of draws."""
    rows = specified(series, rates, tests).withColumns({"tested_pos": expected(F.col("incidence"), F.col("percent_tested")), "tested_noise": expected(F.col("noise"), F.col("percent_tested"))})
    rows = rows.withColumns({"_tp": expected(F.col("tested_pos"), F.col("sensitivity")), "_fp": expected(F.col("tested_noise"), 1 - F.col("specificity"))})
    return _reported(rows, tests, keys)


def drawn_positives(series: DataFrame, rates: list[float], tests: list[TestSpec], keys: list[str], seed: int = 1) -> DataFrame:
    """As expected_positives with binomial draws. The true stream's seeds hold nothing of the noise, so it is the same beside any background."""
    at = [*map(F.col, keys), F.col("day"), F.col("percent_tested")]
    spec = [F.col("sensitivity"), F.col("specificity")]
    streams = [F.xxhash64(F.lit(seed), F.lit(name), *stream) for name, stream in (("tested", at), ("tested noise", at), ("true", at + spec), ("false", at + spec))]

    @F.pandas_udf("tested_pos long, tested_noise long, _tp long, _fp long")
    def drawn(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, true: pd.Series, noise: pd.Series, rate: pd.Series, sens: pd.Series, spec: pd.Series) -> pd.DataFrame:
        rate, true, noise = rate.to_numpy(), true.to_numpy(), noise.to_numpy()
        pos, other = binomial(a.to_numpy(), true, rate), binomial(b.to_numpy(), noise, rate)
        return pd.DataFrame({"tested_pos": pos, "tested_noise": other, "_tp": binomial(c.to_numpy(), pos, sens.to_numpy()), "_fp": binomial(d.to_numpy(), other, 1 - spec.to_numpy())})

    rows = specified(series, rates, tests)
    rows = rows.withColumn("_d", drawn(*streams, "incidence", "noise", "percent_tested", *spec)).select(*rows.columns, "_d.*")
    return _reported(rows, tests, keys)


def _reported(rows: DataFrame, tests: list[TestSpec], keys: list[str]) -> DataFrame:
    lags = [t.test_lag for t in tests]
    rows = rows.withColumns({"true_pos": reported(F.col("_tp"), lags, keys), "false_pos": reported(F.col("_fp"), lags, keys)})
    return rows.withColumn("test_pos", F.col("true_pos") + F.col("false_pos")).drop("_tp", "_fp")
