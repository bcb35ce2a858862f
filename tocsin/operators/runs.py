"""Runs of flagged days by gaps and islands: alerts, outbreaks, day status."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.series import gathered


class OutbreakSpec(NamedTuple):
    threshold: float
    min_duration: int
    min_size: float


def alert_flag(value: Column, threshold: Column) -> Column:
    """The threshold itself raises an alert."""
    return value >= threshold


def islands(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """flagged days with `island`, the same for consecutive days of a series."""
    return flagged.withColumn("island", F.col("day") - F.row_number().over(Window.partitionBy(*keys).orderBy("day")))


def runs(flagged: DataFrame, keys: list[str], index: str, **sums: Column) -> DataFrame:
    """Maximal runs of flagged days: (keys, index, lo, hi, duration, sums), numbered from 1 by start."""
    found = islands(flagged, keys).groupBy(*keys, "island").agg(
        F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("duration"), *(F.sum(c).alias(n) for n, c in sums.items())
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("lo"))
    return found.select(*keys, number.alias(index), "lo", "hi", "duration", *sums)


def outbreak_runs(series: DataFrame, spec: OutbreakSpec | list[OutbreakSpec], keys: list[str]) -> DataFrame:
    """All runs at or above the threshold with their size and status 1 if they are long and large enough.

    A list of specs is judged in one pass; `outbreak_spec` then has a run's spec, counted from 1.
    """
    if isinstance(spec, OutbreakSpec):
        found = runs(series.where(F.col("incidence") >= spec.threshold), keys, "run_idx", size=F.col("incidence"))
        return found.withColumn("status", ((F.col("duration") >= spec.min_duration) & (F.col("size") >= spec.min_size)).cast("int"))
    pick = lambda field: F.element_at(F.array(*(F.lit(float(getattr(s, field))) for s in spec)), F.col("outbreak_spec"))
    numbers = F.explode(F.array(*(F.lit(k) for k in range(1, len(spec) + 1))))
    days = series.select(*keys, "day", "incidence", numbers.alias("outbreak_spec")).where(F.col("incidence") >= pick("threshold"))
    found = runs(days, [*keys, "outbreak_spec"], "run_idx", size=F.col("incidence"))
    return found.withColumn("status", ((F.col("duration") >= pick("min_duration")) & (F.col("size") >= pick("min_size"))).cast("int"))


def outbreaks(series: DataFrame, spec: OutbreakSpec | list[OutbreakSpec], keys: list[str]) -> DataFrame:
    """(keys, outbreak_idx, lo, hi, duration, size) of qualifying runs, numbered anew; of a list, keys and outbreak_spec."""
    if not isinstance(spec, OutbreakSpec):
        number = F.row_number().over(Window.partitionBy(*keys, "outbreak_spec").orderBy("lo"))
        return outbreak_runs(series, spec, keys).where("status = 1").select(*keys, "outbreak_spec", number.alias("outbreak_idx"), "lo", "hi", "duration", "size")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("lo"))
    return outbreak_runs(series, spec, keys).where("status = 1").select(*keys, number.alias("outbreak_idx"), "lo", "hi", "duration", "size")


def marked(series: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """series with `outbreak_idx`, null on days outside outbreaks. Days and starts meet in one shuffle by series."""
    starts = found.select(*keys, F.col("lo").alias("day"), F.struct("outbreak_idx", "hi").alias("_o"), F.lit(0).alias("_turn"))
    rows = gathered([series.withColumn("_turn", F.lit(1)), starts], keys)
    last = F.last("_o", ignorenulls=True).over(Window.partitionBy("_dealt", *keys).orderBy("day", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_o", last).where("_turn = 1")
    return rows.withColumn("outbreak_idx", F.when(F.col("day") <= F.col("_o.hi"), F.col("_o.outbreak_idx"))).drop("_o", "_turn", "_dealt")


def outbreak_status(series: DataFrame, spec: OutbreakSpec, keys: list[str]) -> DataFrame:
    """Every day with 0 or 1. A day meets its run by the island number that both have, so no range join is needed."""
    flagged = islands(series.where(F.col("incidence") >= spec.threshold), keys).select(*keys, "day", "island", "incidence")
    w = Window.partitionBy(*keys, "island")
    inside = flagged.select(*keys, "day", ((F.count("*").over(w) >= spec.min_duration) & (F.sum("incidence").over(w) >= spec.min_size)).cast("int").alias("status"))
    return series.select(*keys, "day").join(inside, [*keys, "day"], "left").select(*keys, "day", F.coalesce("status", F.lit(0)).alias("status"))


def without_outbreak(series_keys: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Series that have no outbreak."""
    return series_keys.join(found, keys, "left_anti")


def require_outbreaks(series_keys: DataFrame, found: DataFrame, keys: list[str]) -> None:
    """Raise if a series has no outbreak, naming the first and how many there are."""
    missing = without_outbreak(series_keys, found, keys)
    n = missing.count()
    if n:
        raise ValueError(f"{n} series without an outbreak, the first is {missing.orderBy(*keys).first().asDict()}")
