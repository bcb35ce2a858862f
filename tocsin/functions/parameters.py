"""Closed-form parameter columns: rates, transmission, equilibrium, initial states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(days: Column) -> Column:
    """Exits per day of a state that lasts `days` on average."""
    return 1 / days


def birth_rate(births_per_k: Column) -> Column:
    """Daily births per head from yearly births per thousand."""
    return 1 / ((1000 / births_per_k) * 365)


def transmission(r0: Column, sigma: Column, gamma: Column, mu: Column) -> Column:
    return r0 * (sigma + mu) * (gamma + mu) / sigma


def reproduction(beta: Column, sigma: Column, gamma: Column, mu: Column) -> Column:
    return beta * sigma / ((sigma + mu) * (gamma + mu))


def import_rate(mu: Column, r0: Column, n: Column) -> Column:
    return 1.06 * mu * (r0 - 1) / F.sqrt(n)


def seasonal(beta: Column, force: Column, day: Column, shape: Column) -> Column:
    """Transmission on a day of the year; shape is cosine or sine."""
    angle = 2 * math.pi * day / 365
    return beta * (1 + force * F.when(shape == "sine", F.sin(angle)).otherwise(F.cos(angle)))


def effective(r0_of_beta: Column, susceptible: Column, n: Column) -> Column:
    return r0_of_beta * susceptible / n


def seasonal_series(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, beta, force, shape, ...) for every day of spans (keys, first, last), with beta_t, that day's transmission.

    The days are made from each span, so no table of days is crossed with the rows. A row without a span has no day.
    """
    days = rows.join(spans, keys).withColumn("day", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return days.withColumn("beta_t", seasonal(F.col("beta"), F.col("force"), F.col("day"), F.col("shape")))


def effective_series(days: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """days of seasonal_series() with reff, the effective reproduction number on states (keys, day, susceptible).

    A day that states lack has a null one.
    """
    r0 = reproduction(F.col("beta_t"), F.col("sigma"), F.col("gamma"), F.col("mu"))
    return days.join(states, [*keys, "day"], "left").withColumn("reff", effective(r0, F.col("susceptible"), F.col("n")))


def equilibrium(r0: Column, beta: Column, sigma: Column, gamma: Column, mu: Column, coverage: Column) -> Column:
    """STRUCT<status, s, e, i, r> of endemic proportions; a status other than ok has null proportions."""
    reff = r0 * (1 - coverage)
    s, i = 1 / r0, mu * (reff - 1) / beta
    e = i * (gamma + mu) / sigma
    r = 1 - s - e - i
    status = F.when((coverage < 0) | (coverage > 1), "coverage").when(reff <= 1, "no endemic state").when(r < 0, "negative").otherwise("ok")
    ok = lambda x: F.when(status == "ok", x)
    return F.struct(status.alias("status"), ok(s).alias("s"), ok(e).alias("e"), ok(i).alias("i"), ok(r).alias("r"))


def initial_counts(n: Column, s: Column, e: Column, i: Column) -> Column:
    """STRUCT<s, e, i, r> of people, halves rounded to even; r has the rest of the proportions."""
    count = lambda p: F.bround(p * n).cast("long")
    return F.struct(count(s).alias("s"), count(e).alias("e"), count(i).alias("i"), count(1 - (s + e + i)).alias("r"))


def background_force(force: Column, correlation: Column) -> Column:
    """Seasonal force of a background series: none without correlation."""
    return F.when(correlation == "none", 0.0).otherwise(force)


def background_shape(shape: Column, correlation: Column) -> Column:
    """Season of a background series: the other one if out of phase."""
    return F.when(correlation != "out-of-phase", shape).when(shape == "sine", "cosine").otherwise("sine")


def background_start(state: Column, coverage: Column, n: Column) -> Column:
    """STRUCT<s, e, i, r>: the equilibrium, or no infection but at least five people of n where there is none."""
    return F.struct(
        F.coalesce(state["s"], 1 - coverage).alias("s"), F.coalesce(state["e"], F.lit(0.0)).alias("e"),
        F.greatest(F.coalesce(state["i"], F.lit(0.0)), 5 / n).alias("i"), F.coalesce(state["r"], coverage).alias("r"),
    )
