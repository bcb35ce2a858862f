"""Scans along series of any length: days in slices, so that one series is the work of many tasks.

A slice's first rows get a halo, the rows before it that a moving window needs. Sums and numbers run within a slice, and
the carry of all slices before it, from one summary row a slice, is joined back. Runs are found within slices; only those
that touch a slice's edge are put together along the series. Series are dense: they have a row for every day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.runs import OutbreakSpec, islands, marked

#: Days of a slice.
SLICE = 1 << 16


def slice_of(day: Column, size: int = SLICE) -> Column:
    """Slices from 0, whose days are 1 to size, size + 1 to 2 size and so on."""
    return F.floor((day - 1) / size)


def trailing_mean(series: DataFrame, keys: list[str], value: str, window: int, name: str, size: int = SLICE) -> DataFrame:
    """Adds the mean of the last `window` days, fewer at the start of a series."""
    reach = slice_of(F.col("day") + max(0, window - 1), size)
    rows = series.withColumn("_own", slice_of(F.col("day"), size)).withColumn("_slice", F.explode(F.sequence("_own", reach)))
    w = Window.partitionBy(*keys, "_slice").orderBy("day").rowsBetween(-(max(1, window) - 1), 0)
    return rows.withColumn(name, F.avg(value).over(w)).where("_slice = _own").drop("_slice", "_own")


def _carried(rows: DataFrame, keys: list[str], each: Column, name: str) -> DataFrame:
    """rows of slices with `name`, the sum of `each` over all slices before their own."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_slice").agg(each.alias("_each")).select(*keys, "_slice", F.coalesce(F.sum("_each").over(before), F.lit(0)).alias(name))
    return rows.join(carry, [*keys, "_slice"])


def running_sum(series: DataFrame, keys: list[str], value: str, name: str, size: int = SLICE) -> DataFrame:
    """Adds the sum of a column up to each day."""
    rows = _carried(series.withColumn("_slice", slice_of(F.col("day"), size)), keys, F.sum(value), "_carry")
    own = F.sum(value).over(Window.partitionBy(*keys, "_slice").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, own + F.col("_carry")).drop("_carry", "_slice")


def numbered(found: DataFrame, keys: list[str], name: str, size: int = SLICE) -> DataFrame:
    """Adds numbers from 1 by `lo` to runs of each series."""
    rows = _carried(found.withColumn("_slice", slice_of(F.col("lo"), size)), keys, F.count("*"), "_carry")
    own = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("lo"))
    return rows.withColumn(name, (own + F.col("_carry")).cast("int")).drop("_carry", "_slice")


def runs(flagged: DataFrame, keys: list[str], index: str, sums: dict[str, Column] | None = None, size: int = SLICE) -> DataFrame:
    """Maximal runs of flagged days with sums over them, as operators.runs.runs() gives them."""
    sums = sums or {}
    within = islands(flagged.withColumn("_slice", slice_of(F.col("day"), size)), [*keys, "_slice"]).groupBy(*keys, "_slice", "island")
    found = within.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("duration"), *(F.sum(c).alias(n) for n, c in sums.items())).drop("_slice", "island")
    edge = (F.pmod(F.col("lo") - 1, F.lit(size)) == 0) | (F.pmod(F.col("hi"), F.lit(size)) == 0)
    w = Window.partitionBy(*keys).orderBy("lo")
    at_edge = found.where(edge).withColumn("_new", (F.col("lo") != F.coalesce(F.lag("hi").over(w), F.lit(-1)) + 1).cast("int"))
    at_edge = at_edge.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = at_edge.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("duration").alias("duration"), *(F.sum(n).alias(n) for n in sums)).drop("_run")
    return numbered(found.where(~edge).unionByName(whole), keys, index, size).select(*keys, index, "lo", "hi", "duration", *sums)


def outbreak_status(series: DataFrame, spec: OutbreakSpec, keys: list[str], size: int = SLICE) -> DataFrame:
    """Every day with 0 or 1; a run that reaches into a slice is told there by its part of it."""
    found = runs(series.where(F.col("incidence") >= spec.threshold), keys, "outbreak_idx", {"size": F.col("incidence")}, size)
    found = found.where((F.col("duration") >= spec.min_duration) & (F.col("size") >= spec.min_size))
    parts = found.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("lo"), size), slice_of(F.col("hi"), size)))).withColumn("lo", F.greatest("lo", (F.col("_slice") * size + 1).cast("int")))
    days = marked(series.select(*keys, "day").withColumn("_slice", slice_of(F.col("day"), size)), parts, [*keys, "_slice"])
    return days.select(*keys, "day", F.col("outbreak_idx").isNotNull().cast("int").alias("status"))
