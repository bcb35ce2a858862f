"""Scenario grids, their keys, and what of them is still to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENARIO_KEYS = [
    "ensemble", "noise_level", "noise_type", "sensitivity", "specificity", "test_lag", "percent_tested", "alert_method", "alert_window",
    "accuracy_metric", "threshold_lower", "threshold_upper", "outbreak_threshold", "min_duration", "min_size", "alert_filtering", "alert_matching",
]


def grid(dimensions: list[DataFrame]) -> DataFrame:
    """Every combination of the rows of small dimension frames, with `ord` counting from 1; the first varies fastest.

    Each dimension is a few rows that name the values of one scenario property. Combinations are numbers of a range,
    which Spark deals to its tasks, and each number is taken apart into a place in every dimension.
    """
    out, size = None, F.lit(1).cast("long")
    for k, d in enumerate(dimensions):
        one = d.agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(f"_r{k}"))  # one row
        out = one if out is None else out.join(F.broadcast(one))
        size = size * F.size(f"_r{k}")
    total = out.select(size).first()[0]
    rows = dimensions[0].sparkSession.range(total).join(F.broadcast(out))
    rest, values = F.col("id"), []
    for k, d in enumerate(dimensions):
        n = F.size(f"_r{k}")
        values.append(F.get(f"_r{k}", (rest % n).cast("int")).alias(f"_v{k}"))
        rest = F.floor(rest / n)
    rows = rows.select((F.col("id") + 1).cast("int").alias("ord"), *values)
    return rows.select("ord", *(F.col(f"_v{k}.{c}").alias(c) for k, d in enumerate(dimensions) for c in d.columns))


def violations(**rules: Column) -> Column:
    """Names of the rules that a row breaks; a rule that is null is broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def scenario_rules() -> dict[str, Column]:
    """What a valid scenario keeps to."""
    unit = lambda c: F.col(c).between(0, 1)
    return {
        "noise_type": F.col("noise_type").isin("static", "dynamic"), "bounds": F.col("threshold_lower") < F.col("threshold_upper"), "lower": F.col("threshold_lower") >= 0,
        "sensitivity": unit("sensitivity"), "specificity": unit("specificity"), "percent_tested": unit("percent_tested"), "test_lag": F.col("test_lag") >= 0,
        "noise_level": F.col("noise_level") >= 0,
    }


def dynamics_rules() -> dict[str, Column]:
    """What valid parameters of a series' dynamics, its population, background and time axis keep to."""
    c = F.col
    return {
        "r0": c("r0") > 0, "latent": c("latent") > 0, "infectious": c("infectious") > 0, "vaccination": (c("min_vaccination") >= 0) & (c("min_vaccination") <= c("max_vaccination")) & (c("max_vaccination") <= 1),
        "force": c("force").between(0, 1), "population": c("n") > 0, "correlation": c("correlation").isin("in-phase", "out-of-phase", "none"), "time": c("tmax") > c("tmin") + c("tstep"), "tstep": c("tstep") > 0,
    }


def scenario_id(keys: list[str]) -> Column:
    """Digest of names and values of all keys; a null differs from any text, and no text can pass for two values."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def completed_keys(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.select(*keys).distinct()


def missing(scenarios: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Scenarios without a result; null keys compare as equal."""
    done = completed_keys(results, keys).select(*(F.col(c).alias(f"_{c}") for c in keys))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return scenarios.join(done, condition, "left_anti")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, first): the groups of scenario rows that share these properties, with the lowest ord; members are
    found by the keys, so no group is gathered."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def run_cost(missing_rows: DataFrame, seconds: float = 1.7, much: float = 300.0) -> DataFrame:
    """(n, seconds, long_run) that computing these rows takes."""
    return missing_rows.agg(F.count("*").alias("n"), (F.count("*") * F.lit(seconds)).alias("seconds"), (F.count("*") * F.lit(seconds) > much).alias("long_run"))
