"""Label and key columns of scenarios, tests and noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_key(**parts: Column) -> Column:
    """name_value parts joined by slashes."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{name}_"), value.cast("string")) for name, value in parts.items()))


def noise_description(kind: Column, correlation: Column) -> Column:
    return F.when(kind == "static", "Poisson").otherwise(F.concat(F.lit("Dynamical, "), correlation))


def noise_magnitude(kind: Column, scaling: Column, coverage: Column) -> Column:
    """What makes a background as large as it is: its scaling if static, else the vaccination coverage."""
    return F.when(kind == "static", F.concat(F.lit("Poisson scaling: "), scaling.cast("string"))).otherwise(F.concat(F.lit("Vaccination coverage: "), coverage.cast("string")))


def method_name(shown: Column) -> Column:
    """The last name before a parenthesis: MovingAverage from AlertMethod.MovingAverage(7)."""
    return F.regexp_extract(shown, "([^.(]+)\\(", 1)


def _percent(x: Column) -> Column:
    return F.bround(x * 100).cast("int").cast("string")


def _unknown(sens: Column, spec: Column, lag: Column) -> Column:
    return F.raise_error(F.concat_ws(" ", F.lit("unknown test:"), sens.cast("string"), spec.cast("string"), lag.cast("string")))


def test_description(sens: Column, spec: Column, lag: Column) -> Column:
    """Long label. The order of the cases matters; an unknown test is an error."""
    elisa = ((sens == 0.98) | (sens == 0.95)) & (spec == 0.98)
    both = F.concat(F.lit("ELISA-like ("), (sens * 100).cast("string"), F.lit("% sens, "), (spec * 100).cast("string"), F.lit("% spec, "), lag.cast("string"), F.lit(" day lag)"))
    return (
        F.when((sens == 1.0) & (spec == 0.0) & (lag == 0), "Clinical case definition")
        .when(elisa, both)
        .when((sens == 1.0) & (spec == 1.0), F.concat(F.lit("Perfect test ("), lag.cast("string"), F.lit(" day lag)")))
        .when((sens == spec) & (sens < 1.0) & (lag == 0), F.concat(F.lit("RDT-like ("), (sens * 100).cast("string"), F.lit("% sens/spec)")))
        .otherwise(_unknown(sens, spec, lag))
    )


def _short(sens: Column, spec: Column, lag: Column, perfect: Column) -> Column:
    return (
        F.when((sens == 1.0) & (spec == 0.0) & (lag == 0), "Clinical Case Definition")
        .when((sens == spec) & (sens < 1.0) & (lag == 0), F.concat(F.lit("Imperfect Test ("), _percent(sens), F.lit("%)")))
        .when((sens == 1.0) & (spec == 1.0), perfect)
        .otherwise(_unknown(sens, spec, lag))
    )


def table_label(sens: Column, spec: Column, lag: Column) -> Column:
    return _short(sens, spec, lag, F.lit("Perfect Test"))


def plot_label(sens: Column, spec: Column, lag: Column) -> Column:
    return _short(sens, spec, lag, F.concat(F.lit("Perfect Test ("), lag.cast("string"), F.lit("-day lag)")))


def noise_label(kind: Column) -> Column:
    """Named kinds, else the name with each part between underscores capitalised."""
    titled = F.array_join(F.transform(F.split(kind, "_"), F.initcap), "_")
    return F.when(kind.isin("static", "poisson"), "Static Noise").when(kind.isin("dynamic", "dynamical_inphase"), "Dynamical Noise").otherwise(titled)
