"""Reports on stored results: filters, orders, pivots, exact percentiles, comparisons, resampled intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.labels import table_label
from tocsin.operators.series import uniforms
from tocsin.plans.sweep import MOST_ROWS, SALTS

SPEC = ["sensitivity", "specificity", "test_lag"]
#: Measures that a report may show.
MEASURES = (
    "optimal_threshold", "accuracies", "proportion_alerts_correct", "proportion_outbreaks_detected", "detection_delays", "unavoidable_cases", "alert_durations",
    "outbreak_durations", "proportion_timeseries_in_alert", "proportion_timeseries_in_outbreak", "n_alerts",
)
ALL_NOISE = "all_noise_structures"
#: A percentile's sketch is off by n / ACCURACY ranks at most.
ACCURACY = 10_000


def configured(results: DataFrame, **values: object) -> DataFrame:
    """Rows with these values; None asks for null. All configuration columns are given, there is no default."""
    for column, value in values.items():
        results = results.where(F.col(column).eqNullSafe(F.lit(value)))
    return results


def cell_table(results: DataFrame) -> DataFrame:
    """Adds i and j by joining ranks of the distinct types and levels, which are few."""
    types = results.select("noise_type").distinct().select("noise_type", F.row_number().over(Window.orderBy(F.desc("noise_type"))).alias("i"))
    levels = results.select("noise_level").distinct().select("noise_level", F.row_number().over(Window.orderBy("noise_level")).alias("j"))
    return results.join(types, "noise_type").join(levels, "noise_level")


def spec_order(*more: str) -> list[Column]:
    """Tests by sensitivity, specificity, then the longest lag first."""
    return [F.col("sensitivity"), F.col("specificity"), F.desc("test_lag"), *map(F.col, more)]


def distinct_specs(results: DataFrame) -> DataFrame:
    """Distinct tests with their place; a handful of rows."""
    return results.select(*SPEC).distinct().withColumn("place", F.row_number().over(Window.orderBy(*spec_order())))


def level_groups(results: DataFrame) -> DataFrame:
    return results.groupBy("noise_level").agg(F.count("*").alias("n"))


def levels_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Levels that one selection has and the other lacks."""
    a, b = a.select("noise_level").distinct(), b.select("noise_level").distinct()
    return a.exceptAll(b).union(b.exceptAll(a))


def same(a: str, b: str, keys: list[str]) -> Column:
    """Equality of all keys of two aliased tables; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows with the other columns of their group; nulls in keys are equal.

    A few groups go to every task, so that rows stay where they are; else a group's rows are dealt to SALTS parts by the
    task that they come from, as one group may hold most rows.
    """
    more = [c for c in groups.columns if c not in keys]
    on = keys if few else [*keys, "_salt"]
    if few:
        groups = F.broadcast(groups)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.alias("x").join(groups.alias("y"), same("x", "y", on)).select("x.*", *(F.col(f"y.`{c}`") for c in more)).drop("_salt")


def percentiles(
    df: DataFrame, keys: list[str], value: str, names: dict[str, float], more: tuple[Column, ...] = (), accuracy: int = ACCURACY,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(keys, more..., names...): exact interpolated percentiles of each group, and further aggregates.

    Distributed selection. A mergeable sketch brackets every asked rank; one pass counts, in partial sums, the values
    below a bracket, and each distinct value inside it; only these are sorted, about 8 / accuracy of a group's rows, or
    all of a group of fewer than `accuracy`. A bracket that doesn't hold its rank raises an error. Nulls are skipped; a
    group without values has null.

    keep writes a table and reads it back: brackets, a row a group, are then made once and counted, and a few of them go
    to where the rows are; without it, all rows are shuffled to meet them. df is computed twice, so it should be cheap.
    """
    group = keys or ["_all"]
    rows = df.withColumn("_v", F.col(value).cast("double"))
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    points = list(names.values())
    near = lambda sign: F.percentile_approx("_v", F.array(*(F.lit(min(1.0, max(0.0, p + sign * 4 / accuracy))) for p in points)), F.lit(accuracy))
    whole = lambda edge, of: F.when(F.col("_n") < accuracy, F.array(*[F.col(edge)] * len(points))).otherwise(F.col(of))
    brackets = rows.groupBy(*group).agg(F.count("_v").alias("_n"), near(-1).alias("_lo"), near(1).alias("_hi"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *more)
    brackets = brackets.withColumns({"_lo": whole("_min", "_lo"), "_hi": whole("_max", "_hi")}).drop("_min", "_max")
    brackets = keep(brackets) if keep else brackets
    few = keep is not None and brackets.count() <= MOST_ROWS
    asked = brackets.select(*group, F.posexplode(F.arrays_zip("_lo", "_hi", F.array(*(F.lit(p) * (F.col("_n") - 1) for p in points)).alias("_at"))).alias("_k", "_b"))
    asked = asked.select(*group, "_k", "_b._at", F.floor("_b._at").alias("_low"), F.ceil("_b._at").alias("_high"))

    own = with_group(rows.where("_v is not null").select(*group, "_v"), brackets.select(*group, "_lo", "_hi"), group, few)
    # a value below its bracket counts as null, one above doesn't count
    inside = F.filter(F.transform("_lo", lambda lo, k: F.struct(k.alias("k"), F.when(F.col("_v") >= lo, F.col("_v")).alias("v"), (F.col("_v") <= F.get("_hi", k)).alias("in"))), lambda s: s["in"])
    counts = own.select(*group, F.explode(inside).alias("_s")).groupBy(*group, F.col("_s.k").alias("_k"), F.col("_s.v").alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group, "_k").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).alias("x").join(asked.alias("y"), same("x", "y", [*group, "_k"])).select("x.*", "_at", "_low", "_high")
    found = ranked.groupBy(*group, "_k", "_at", "_low", "_high").agg(
        F.min(F.when(F.col("_upto") > F.col("_low"), F.struct("_upto", "_v"))).alias("_a"), F.min(F.when(F.col("_upto") > F.col("_high"), F.struct("_upto", "_v"))).alias("_b")
    )
    held = F.col("_a._v").isNotNull() & F.col("_b._v").isNotNull()
    between = F.when(F.col("_low") == F.col("_high"), F.col("_a._v")).otherwise((F.col("_high") - F.col("_at")) * F.col("_a._v") + (F.col("_at") - F.col("_low")) * F.col("_b._v"))
    found = found.select(*group, "_k", F.when(held, between).otherwise(F.raise_error(F.lit("a bracket misses its rank")).cast("double")).alias("_p"))
    wide = found.groupBy(*group).agg(*(F.max(F.when(F.col("_k") == k, F.col("_p"))).alias(name) for k, name in enumerate(names)))
    totals = brackets.drop("_n", "_lo", "_hi")
    return totals.alias("x").join(wide.alias("y"), same("x", "y", group), "left").select(*(F.col(f"x.`{c}`") for c in totals.columns if c != "_all"), *(F.col(f"y.`{n}`") for n in names))


def summary(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.1, 0.9), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys, mean, p..): mean and exact interpolated percentiles; nulls are skipped, nothing gives null."""
    return percentiles(df, keys, value, {f"p{round(100 * p)}": p for p in points}, (F.avg(value).alias("mean"),), keep=keep)


def flattened(df: DataFrame, keys: list[str], nested: str, name: str = "value") -> DataFrame:
    """One row for each element of an array of arrays."""
    return df.select(*keys, F.explode(F.flatten(nested)).alias(name))


def measure(results: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, value) of a permitted measure."""
    if name not in MEASURES:
        raise ValueError(f"no such measure: {name}")
    return results.select(*keys, F.col(name).alias("value"))


def cell_values(df: DataFrame, keys: list[str], nested: str, name: str = "value") -> DataFrame:
    """(keys, name): mean of all elements of the cells' arrays. Each array is folded where it is, and sums are added up,
    so no cell is gathered; text is made at export only."""
    folded = df.select(*keys, F.aggregate(nested, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))).alias("_t"), F.size(F.filter(nested, lambda x: x.isNotNull())).alias("_n"))
    return folded.groupBy(*keys).agg((F.sum("_t") / F.nullif(F.sum("_n"), F.lit(0))).alias(name))


def as_text(value: str, digits: int = 2) -> Column:
    """A cell as text with so many digits, for export; null stays null."""
    return F.when(F.col(value).isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits)))


def repeated_cells(long: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, percent_tested) that occur more than once, which a pivot can't show."""
    return long.groupBy(*ids, "percent_tested").count().where("count > 1")


def wide(long: DataFrame, ids: list[str], percents: list[float], value: str = "value") -> DataFrame:
    """One column for each testing rate, ascending, with the test's label; a repeated cell raises an error."""
    one = F.when(F.count(F.lit(1)) <= 1, F.first("_v")).otherwise(F.raise_error(F.lit("a cell of the report occurs twice")).cast("double"))
    table = long.withColumn("_v", F.col(value).cast("double")).groupBy(*ids).pivot("percent_tested", sorted(percents)).agg(one)
    return table.withColumn("test_type", table_label(*map(F.col, SPEC)))


def percent_columns(df: DataFrame) -> list[str]:
    """Columns whose names are numbers."""

    def number(c: str) -> bool:
        try:
            float(c)
        except ValueError:
            return False
        return True

    return [c for c in df.columns if number(c)]


def collapsed(table: DataFrame) -> DataFrame:
    """Perfect tests of all noise as one row for each lag, the first by noise type and level; others unchanged."""
    percents = percent_columns(table)
    perfect = table.where("test_type = 'Perfect Test'")
    first = F.min_by(F.struct("sensitivity", "specificity", *(F.col(f"`{p}`") for p in percents)), F.struct("noise_type", "noise_level")).alias("_f")
    one = perfect.groupBy("test_type", "test_lag").agg(first)
    one = one.select(F.lit(ALL_NOISE).alias("noise_type"), F.lit(None).cast("double").alias("noise_level"), "test_lag", "test_type", F.col("_f.sensitivity"), F.col("_f.specificity"), *(F.col(f"_f.`{p}`").alias(p) for p in percents))
    rest = table.where("test_type <> 'Perfect Test'").withColumn("noise_level", F.col("noise_level").cast("double"))
    return rest.unionByName(one, allowMissingColumns=True)


def presented(table: DataFrame) -> DataFrame:
    """Names for readers: recoded noise types, titled columns, percent headers."""
    recoded = F.when(F.col("noise_type") == "static", "Static Noise").when(F.col("noise_type") == "dynamic", "Dynamic Noise").when(F.col("noise_type") == ALL_NOISE, "All noise structures").otherwise(F.col("noise_type"))
    names = {"noise_type": "Noise Type", "test_type": "Test Type", "test_lag": "Test Lag"} | {p: f"{round(100 * float(p))}%" for p in percent_columns(table)}
    return table.withColumn("noise_type", recoded).withColumnsRenamed(names)


def at_level(table: DataFrame, level: float) -> DataFrame:
    return table.where((F.col("noise_level") == level) | (F.col("noise_type") == ALL_NOISE))


def baseline_difference(long: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """(ids, mean_difference) from the perfect test without lag, averaged over testing rates.

    long: (ids with SPEC, percent_tested, value). Each rate needs exactly one baseline value.
    """
    perfect = (F.col("sensitivity") == 1.0) & (F.col("specificity") == 1.0) & (F.col("test_lag") == 0)
    base = long.where(perfect).groupBy("percent_tested").agg(F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.lit("the baseline isn't unique")).cast("double")).alias("base"))
    return long.where(~perfect).join(base, "percent_tested").groupBy(*ids).agg(F.avg(F.col(value) - F.col("base")).alias("mean_difference"))


def spread_of_means(values: DataFrame, scenario: list[str], keys: list[str], digits: int = 2, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys, lowest, highest, mean, median) of scenario means, rounded."""
    means = values.groupBy(*keys, *scenario).agg(F.avg("value").alias("m"))
    means = keep(means) if keep else means
    found = percentiles(means, keys, "m", {"median": 0.5}, (F.min("m").alias("lowest"), F.max("m").alias("highest"), F.avg("m").alias("mean")), keep=keep)
    return found.select(*keys, *(F.bround(c, digits).alias(c) for c in ("lowest", "highest", "mean", "median")))


def inconsistent(results: DataFrame, keys: list[str], order: str, values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Perfect-test rows whose values differ from those of the first row with the same keys."""
    perfect = results.where((F.col("sensitivity") == 1.0) & (F.col("specificity") == 1.0) & (F.col("test_lag") == 0))
    w = Window.partitionBy(*keys).orderBy(order)
    bad = F.lit(False)
    for v in values:
        bad |= F.abs(F.col(v) - F.first(v).over(w)) > tolerance
    return perfect.withColumn("_bad", bad).where("_bad").drop("_bad")


def confusion(prevalence: DataFrame, step: float = 0.05, n: int = 20) -> DataFrame:
    """Counts of a test on each row's (positives, negatives) over a grid of sensitivity and specificity."""
    axis = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: k * F.lit(step))
    rows = prevalence.select("*", F.explode(axis).alias("sens")).select("*", F.explode(axis).alias("spec"))
    rows = rows.withColumns({"tp": F.col("positives") * F.col("sens"), "tn": F.col("negatives") * F.col("spec")})
    rows = rows.withColumns({"fn": F.col("positives") - F.col("tp"), "fp": F.col("negatives") - F.col("tn")})
    rows = rows.withColumns({"test_pos": F.col("tp") + F.col("fp"), "test_neg": F.col("tn") + F.col("fn")})
    part = lambda a, b: F.col(a) / F.when(F.col(b) != 0, F.col(b))
    return rows.withColumns({"ppv": part("tp", "test_pos"), "npv": part("tn", "test_neg")})


def difference_summary(draws: DataFrame, keys: list[str], value: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    names = {"median": 0.5} | {f"q{round(100 * p)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return percentiles(draws, keys, value, names, (F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")), keep=keep)


def _replicate_sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """A task's (replicate, sum of weights, sum of weighted values)."""
    chance = np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 18)])
    steps = np.cumsum(chance)  # distribution function of Poisson(1)
    turn = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w, wv = np.zeros(replicates), np.zeros(replicates)
    for batch in batches:
        h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for at in range(0, len(h), 512):
            weight = np.searchsorted(steps, uniforms(h[at : at + 512, None] ^ turn), side="right")
            w += weight.sum(axis=0)
            wv += v[at : at + 512] @ weight
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), pa.array(w), pa.array(wv)], ["replicate", "w", "wv"])


def bootstrap(values: DataFrame, id_col: str, value: str, replicates: int = 1000, interval: float = 0.95, seed: int = 1) -> DataFrame:
    """One row with the mean and its bias-corrected, accelerated bootstrap interval.

    A row's weight in a replicate is Poisson(1), drawn from a hash of (seed, replicate, id), so replicates need no
    resampling: each task keeps one pair of sums for each replicate, and no row is made for a row and replicate.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), id_col).alias("h"), F.col(value).cast("double").alias("v"))
    sums = rows.mapInArrow(partial(_replicate_sums, replicates=replicates), "replicate int, w double, wv double")
    means = sums.groupBy("replicate").agg((F.sum("wv") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).where("m is not null")
    base = rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.var_pop("v").alias("var"), F.skewness("v").alias("skew")).first()
    if not base["n"]:
        return rows.agg(F.avg("v").alias("mean"), F.avg("v").alias("low"), F.avg("v").alias("high"))
    from statistics import NormalDist

    normal = NormalDist()
    share = means.agg(F.avg((F.col("m") < base["mean"]).cast("double"))).first()[0]
    z0 = normal.inv_cdf(min(max(share, 1 / (2 * replicates)), 1 - 1 / (2 * replicates)))
    skew = base["skew"] if base["skew"] is not None and base["skew"] == base["skew"] else 0.0
    acceleration = skew / (6 * base["n"] ** 0.5)  # of the jackknife means, which are linear in the values

    def point(q: float) -> float:
        z = normal.inv_cdf(q)
        return normal.cdf(z0 + (z0 + z) / (1 - acceleration * (z0 + z)))

    tail = (1 - interval) / 2
    return means.agg(F.lit(base["mean"]).alias("mean"), F.percentile("m", F.lit(point(tail))).alias("low"), F.percentile("m", F.lit(point(1 - tail))).alias("high"))
