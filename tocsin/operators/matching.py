"""Interval matching of alerts and outbreaks by a sorted merge.

The outbreaks of a series are disjoint and numbered by start, as are its alerts. Starts and ends are put in one order;
the last outbreak begun at an alert's start and the last begun before its end say which outbreaks it meets, so no alert
is held against outbreaks that it doesn't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.series import gathered

ALL_ALERTS, POST_START = "AllAlerts", "PostOutbreakStartAlerts"
SINGLE, MULTIPLE = "SingleOutbreakPerAlert", "MultipleOutbreaksPerAlert"


def overlaps(a_lo: Column, a_hi: Column, o_lo: Column, o_hi: Column, filtering: str = ALL_ALERTS) -> Column:
    """Whether an alert meets an outbreak: it starts inside, or (AllAlerts) began before and ends after the first day."""
    inside = (a_lo >= o_lo) & (a_lo <= o_hi)
    if filtering == POST_START:
        return inside
    if filtering != ALL_ALERTS:
        raise ValueError(f"no such filter: {filtering}")
    return inside | ((a_lo <= o_lo) & (a_hi > o_lo))


def matches(alerts: DataFrame, outbreaks: DataFrame, keys: list[str], by: list[str] | None = None, filtering: str = ALL_ALERTS, matching: str = SINGLE) -> DataFrame:
    """(keys, outbreak_idx, alert_idx, alert_lo, outbreak_lo) pairs that meet.

    keys name a series of alerts, `by` (default: keys) those of them that outbreaks have too. Outbreaks of a series are
    disjoint and numbered from 1 by start. With SingleOutbreakPerAlert an alert goes to its first outbreak.
    """
    if filtering not in (ALL_ALERTS, POST_START):
        raise ValueError(f"no such filter: {filtering}")
    if matching not in (SINGLE, MULTIPLE):
        raise ValueError(f"no such matching: {matching}")
    own = outbreaks if by in (None, keys) else alerts.select(*keys).distinct().join(outbreaks, by)
    own = own.select(*keys, "outbreak_idx", F.col("lo").alias("outbreak_lo"), "hi")
    # at one day: ends of alerts, then starts of outbreaks, then starts of alerts
    begun = own.select(*keys, F.col("outbreak_lo").alias("at"), F.lit(1).alias("turn"), F.struct("outbreak_idx", "hi").alias("o"))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(2).alias("turn")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("turn"))))
    sides = alerts.select(*keys, "alert_idx", F.col("lo").alias("alert_lo"), ends.alias("e")).select(*keys, "alert_idx", "alert_lo", "e.*")
    w = Window.partitionBy("_dealt", *keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    last = gathered([begun, sides], keys).withColumn("o", F.last("o", ignorenulls=True).over(w)).where("alert_idx is not null")
    at = lambda turn: F.max(F.when(F.col("turn") == turn, F.col("o")))
    met = last.groupBy("_dealt", *keys, "alert_idx", "alert_lo").agg(at(2).alias("start"), at(0).alias("end"))
    inside = F.coalesce(F.col("start.hi") >= F.col("alert_lo"), F.lit(False))
    first = F.coalesce("start.outbreak_idx", F.lit(0)) + F.when(inside, 0).otherwise(1)
    most = F.when(inside, F.greatest("start.outbreak_idx", "end.outbreak_idx")).otherwise(F.coalesce("end.outbreak_idx", F.lit(0)))
    if filtering == POST_START:
        met, most = met.where(inside), first
    met = met.withColumns({"first": first, "most": most}).where("first <= most")
    numbers = F.col("first") if matching == SINGLE else F.explode(F.sequence("first", "most"))
    met = met.select(*keys, numbers.alias("outbreak_idx"), "alert_idx", "alert_lo")
    return met.join(own.drop("hi"), [*keys, "outbreak_idx"]).select(*keys, "outbreak_idx", "alert_idx", "alert_lo", "outbreak_lo")


def matched_lists(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per outbreak with an alert: its alerts in order."""
    return pairs.groupBy(*keys, "outbreak_idx").agg(F.sort_array(F.collect_list("alert_idx")).alias("alerts"), F.count("*").alias("n"))


def matched_alerts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct alerts that meet an outbreak."""
    return pairs.select(*keys, "alert_idx").distinct()


def violations(pairs: DataFrame, alerts: DataFrame, outbreaks: DataFrame, keys: list[str], matching: str = SINGLE) -> DataFrame:
    """Pairs that can't be: unknown alert or outbreak, a pair twice, or an alert with two outbreaks under SINGLE."""
    unknown = pairs.join(alerts.select(*keys, "alert_idx"), [*keys, "alert_idx"], "left_anti").select(*keys, "alert_idx", F.lit("alert").alias("problem"))
    missing = pairs.join(outbreaks.select(*keys, "outbreak_idx"), [*keys, "outbreak_idx"], "left_anti").select(*keys, "alert_idx", F.lit("outbreak").alias("problem"))
    unique = [*keys, "alert_idx"] if matching == SINGLE else [*keys, "outbreak_idx", "alert_idx"]
    twice = pairs.groupBy(*unique).count().where("count > 1").select(*keys, "alert_idx", F.lit("repeated").alias("problem"))
    return unknown.union(missing).union(twice)


def first_alerts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per matched outbreak its first alert."""
    first = F.min(F.struct("alert_idx", "alert_lo", "outbreak_lo")).alias("_f")
    return pairs.groupBy(*keys, "outbreak_idx").agg(first).select(*keys, "outbreak_idx", "_f.*")
