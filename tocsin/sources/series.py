"""Count series: events to one row for each series and day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suppliers, two numbers each, that every task may get whole.
MOST_SUPPLIERS = 1_000_000


def count_series(events: DataFrame, keys: list[str], day: Column, **counts: Column) -> DataFrame:
    """Events counted by series and day; each named column counts the rows where its condition holds."""
    return events.groupBy(*keys, day.alias("day")).agg(*(F.count_if(c).alias(name) for name, c in counts.items()))


def numbered_days(counts: DataFrame, unit: str = "DAY") -> DataFrame:
    """counts with `day` as a number from 1, the first date or time that any series has; unit DAY or HOUR."""
    first = counts.agg(F.min("day").alias("_first"))  # one row
    steps = F.timestamp_diff(unit, F.col("_first").cast("timestamp_ntz"), F.col("day").cast("timestamp_ntz")) + 1
    return counts.crossJoin(F.broadcast(first)).withColumn("day", steps.cast("int")).drop("_first")


def dense_days(counts: DataFrame, series: DataFrame, keys: list[str], values: list[str], bounds: tuple[int, int] | None = None) -> DataFrame:
    """Every series of `series` on every day from the first to the last that counts has, missing counts as 0.

    bounds gives other ends; a count outside them then raises an error when it is read. Counts without a day are of none.
    """
    if bounds is None:
        ends = counts.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))  # one row
        axis = series.select(*keys).crossJoin(F.broadcast(ends))
    else:
        outside = F.raise_error(F.concat_ws(" ", F.lit("a count lies outside the days, at"), F.col("day").cast("string"))).cast("int")
        counts = counts.where(F.col("day").isNotNull()).withColumn("day", F.when(F.col("day").between(*bounds), F.col("day")).otherwise(outside))
        axis = series.select(*keys, F.lit(bounds[0]).alias("_first"), F.lit(bounds[1]).alias("_last"))
    axis = axis.select(*keys, F.explode(F.sequence("_first", "_last")).alias("day"))
    joined = axis.join(counts, [*keys, "day"], "left" if bounds is None else "full_outer")
    return joined.select(*keys, "day", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sim, date, returned): order lines by their supplier's region and ship date.

    Suppliers are counted, which reads no column, and go to every task unless they are many, so that lines stay where
    they are until they are counted.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    suppliers = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("sim"))
    suppliers = F.broadcast(suppliers) if read("supplier").count() <= MOST_SUPPLIERS else suppliers
    lines = read("lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), (F.col("l_returnflag") == "R").alias("returned"))
    return lines.join(suppliers, "l_suppkey").select("sim", "date", "returned")


def line_counts(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sim, day, incidence, noise) of days with order lines: returned ones are the signal, others the background.

    keep writes a table and reads it back: lines are counted once, and the first day is taken from the counts.
    """
    return numbered_days(keep(count_series(shipped_lines(spark, sf_dir), ["sim"], F.col("date"), incidence=F.col("returned"), noise=~F.col("returned"))))


def line_series(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Dense (sim, day, incidence, noise) of order lines, from the first ship date to the last; keep as in line_counts()."""
    sims = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("sim"))
    return dense_days(line_counts(spark, sf_dir, keep), sims, ["sim"], ["incidence", "noise"])


def event_series(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Dense (sim, day, incidence) of events: one series for each type, one step for each hour from the first on; keep as in line_counts()."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("sim"), F.date_trunc("HOUR", F.col("ts").cast("timestamp_ntz")).alias("hour"))
    counts = keep(count_series(events, ["sim"], F.col("hour"), incidence=F.lit(True)))  # types without a time have a row too
    return dense_days(numbered_days(counts, "HOUR"), counts.select("sim").distinct(), ["sim"], ["incidence"])
