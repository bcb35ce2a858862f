"""Detection metrics of each series. An undefined ratio is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.series import gathered


def ratio(part: Column, whole: Column) -> Column:
    return part / F.when(whole != 0, whole)


def balanced(ppv: Column, sensitivity: Column) -> Column:
    """Mean of what is defined of the two."""
    n = ppv.isNotNull().cast("int") + sensitivity.isNotNull().cast("int")
    return ratio(F.coalesce(ppv, F.lit(0.0)) + F.coalesce(sensitivity, F.lit(0.0)), n)


def f_beta(ppv: Column, sensitivity: Column, beta: float = 1.0) -> Column:
    """0 where it isn't defined, unlike balanced()."""
    b = beta * beta
    return F.coalesce(ratio((1 + b) * ppv * sensitivity, b * ppv + sensitivity), F.lit(0.0))


def accuracy(metric: Column, ppv: Column, sensitivity: Column) -> Column:
    return F.when(metric == "F1", f_beta(ppv, sensitivity)).when(metric == "BalancedAccuracy", balanced(ppv, sensitivity))


def _tallied(series_keys: DataFrame, alerts: DataFrame, outbreaks: DataFrame, pairs: DataFrame, keys: list[str], lists: dict[str, DataFrame], *more: str) -> DataFrame:
    """One row a series from tagged rows of all parts, in one grouping: counts, days in runs, and lists (keys, idx, value) in order."""
    row = lambda df, kind, **c: df.select(*keys, F.lit(kind).alias("kind"), *(v.alias(k) for k, v in c.items()))
    parts = [series_keys.select(*keys, *more, F.lit("series").alias("kind"))]
    parts += [row(df, kind, idx=F.col(f"{kind}_idx"), value=F.col("duration").cast("long")) for df, kind in ((alerts, "alert"), (outbreaks, "outbreak"))]
    parts += [row(pairs, "pair", idx=F.col("outbreak_idx"), other=F.col("alert_idx"))]
    parts += [row(df, name, idx=F.col("idx"), value=F.col("value").cast("long")) for name, df in lists.items()]
    rows = gathered(parts, keys)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("idx", "value")))), lambda x: x["value"])
    named = {"alert_durations": "alert", "outbreak_durations": "outbreak"} if lists else {}
    aggregates = [
        F.count(of("alert", "kind")).alias("n_alerts"), F.count(of("outbreak", "kind")).alias("n_outbreaks"),
        F.count_distinct(of("pair", "other")).alias("n_matched_alerts"), F.count_distinct(of("pair", "idx")).alias("n_matched_outbreaks"),
        F.coalesce(F.sum(of("alert", "value")), F.lit(0)).alias("alert_days"), F.coalesce(F.sum(of("outbreak", "value")), F.lit(0)).alias("outbreak_days"),
        *(listed(k).alias(n) for n, k in ({name: name for name in lists} | named).items()), *(F.max(c).alias(c) for c in more), F.count(of("series", "kind")).alias("_known"),
    ]
    return rows.groupBy("_dealt", *keys).agg(*aggregates).where("_known > 0").drop("_known", "_dealt")


def series_counts(series_keys: DataFrame, alerts: DataFrame, outbreaks: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_alerts, n_outbreaks, n_matched_alerts, n_matched_outbreaks), 0 where a series has none."""
    return _tallied(series_keys, alerts, outbreaks, pairs, keys, {}).drop("alert_days", "outbreak_days")


def rates(counts: DataFrame, metric: str = "BalancedAccuracy") -> DataFrame:
    """Adds sensitivity, ppv and accuracy."""
    out = counts.withColumns({"sensitivity_": ratio(F.col("n_matched_outbreaks"), F.col("n_outbreaks")), "ppv": ratio(F.col("n_matched_alerts"), F.col("n_alerts"))})
    return out.withColumn("accuracy", accuracy(F.lit(metric), F.col("ppv"), F.col("sensitivity_"))).withColumnRenamed("sensitivity_", "detected")


def delays(firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Days from an outbreak's start to its first alert; negative if the alert came before."""
    return firsts.select(*keys, "outbreak_idx", (F.col("alert_lo") - F.col("outbreak_lo")).alias("delay"))


def unavoidable(series: DataFrame, outbreaks: DataFrame, firsts: DataFrame, keys: list[str], by: list[str] | None = None, series_keys: DataFrame | None = None, slice_days: int | None = None) -> DataFrame:
    """(keys, outbreak_idx, cases): cases from an outbreak's start to the day before its first alert, all if it has none.

    Differences of running sums, fetched by equality on (series, day). series_keys names series of alerts where these
    have further keys; slice_days lets the sums run in slices of so many days, for series too long for one task.
    """
    from tocsin.operators.slices import running_sum

    by = by or keys
    running = running_sum(series, by, "incidence", "upto", slice_days).select(*by, "day", "upto") if slice_days else series.select(*by, "day", F.sum("incidence").over(Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    every = outbreaks if series_keys is None else series_keys.select(*keys).join(outbreaks, by)
    told = every.join(firsts.select(*keys, "outbreak_idx", "alert_lo"), [*keys, "outbreak_idx"], "left")
    until = F.when(F.col("alert_lo").isNull(), F.col("hi")).otherwise(F.greatest(F.col("alert_lo"), F.col("lo")) - 1)
    ends = F.array(F.struct((F.col("lo") - 1).alias("day"), F.lit(-1).alias("sign")), F.struct(until.alias("day"), F.lit(1).alias("sign")))
    told = told.select(*keys, "outbreak_idx", F.explode(ends).alias("_e")).select(*keys, "outbreak_idx", "_e.*")
    found = told.join(running, [*by, "day"], "left").groupBy(*keys, "outbreak_idx")
    return found.agg(F.sum(F.col("sign") * F.coalesce("upto", F.lit(0))).alias("cases"))


def share_of_time(series_keys: DataFrame, found: DataFrame, keys: list[str], name: str, length: str = "length") -> DataFrame:
    """Days in runs as a share of the series' days, which series_keys has; null if it has none."""
    sums = found.groupBy(*keys).agg(F.sum("duration").alias("_days"))
    return series_keys.join(sums, keys, "left").select(*keys, ratio(F.coalesce("_days", F.lit(0)), F.col(length)).alias(name))


def record(series_keys: DataFrame, series: DataFrame, alerts: DataFrame, outbreaks: DataFrame, pairs: DataFrame, keys: list[str], metric: str, by: list[str] | None = None) -> DataFrame:
    """All metrics of each series at a threshold, lists in order of outbreaks or alerts.

    series_keys has a series' keys and `length`, its days; outbreaks have all keys, series only those in `by`.
    """
    from tocsin.operators.matching import first_alerts

    firsts = first_alerts(pairs, keys)
    lists = {
        "delays": delays(firsts, keys).withColumnsRenamed({"outbreak_idx": "idx", "delay": "value"}),
        "unavoidable_cases": unavoidable(series, outbreaks, firsts, keys, by, series_keys=None).withColumnsRenamed({"outbreak_idx": "idx", "cases": "value"}),
    }
    out = rates(_tallied(series_keys, alerts, outbreaks, pairs, keys, lists, "length"), metric)
    return out.withColumns({f"share_in_{k}": ratio(F.col(f"{k}_days"), F.col("length")) for k in ("alert", "outbreak")}).drop("alert_days", "outbreak_days", "length")
