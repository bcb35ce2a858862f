"""Threshold sweeps: every candidate threshold of every scenario in one job, the best one, and the resumable driver.

Days are not crossed with thresholds. An alert begins on a day for just the candidates above the day before and not
above the day itself, an interval of ranks; so is what a day's start, or a run that reaches an outbreak, detects. Each
day makes at most two intervals, whose ends are summed along the candidates of its series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tocsin.operators.matching import ALL_ALERTS, MULTIPLE, POST_START, SINGLE, matches
from tocsin.operators.metrics import accuracy, ratio, record
from tocsin.operators.runs import runs
from tocsin.operators.series import compared, gathered
from tocsin.plans.scenarios import merged, missing
from tocsin.sources.results import append_checkpoint, batch_digest, compact, contained, has_snapshot, load_checkpoints, load_snapshot

#: Rows of a table that every task may get whole, and parts that a larger one is joined in.
MOST_ROWS, SALTS = 100_000, 64


def equal_grid(lower: float, upper: float, n: int) -> list[float]:
    return [lower + k * (upper - lower) / n for k in range(n + 1)]


def breakpoints(prepared: DataFrame, lower: float, scenario: list[str], value: str = "value") -> DataFrame:
    """(scenario, T): values from `lower` on at which accuracy can change, and the scenario's largest or `lower`.

    Accuracy is constant between neighbouring values, so with these the optimum is exact. Their number is bounded by
    the counts' range, not by the rows, and they stay a table.
    """
    found = prepared.where(F.col(value) >= lower).select(*scenario, F.col(value).cast("double").alias("T"))
    upper = prepared.groupBy(*scenario).agg(F.greatest(F.max(value).cast("double"), F.lit(float(lower))).alias("T"))
    return found.union(upper).distinct()


def prepared(positives: DataFrame, method: str) -> DataFrame:
    """positives with `value`, what the method compares."""
    return positives.withColumn("value", compared(F.lit(method)))


def beside(rows: DataFrame, table: DataFrame, on: list[str], most: int = MOST_ROWS) -> DataFrame:
    """Inner join with a written table of few rows a scenario: sent to every task if its rows, counted, are few, else
    joined in parts, as a scenario may hold most rows."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt")


def series_names(ready: DataFrame, keys: list[str]) -> DataFrame:
    """Every series with `series_id`, one long for all its keys (float keys would be dealt anew at each step), and its length."""
    return ready.groupBy(*keys).agg(F.count("*").cast("int").alias("length")).withColumn("series_id", F.xxhash64(*keys))


def rank(value: Column, candidates: list[float]) -> Column:
    """How many of the ascending candidates a value reaches; by halving."""
    grid = F.array(*map(F.lit, candidates))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(candidates).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda r, s: F.when(F.get(grid, r + s - 1) <= value, r + s).otherwise(r))


def merged_ranks(values: DataFrame, candidates: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario, value, r): how many of its scenario's candidates (scenario, T) each distinct value reaches.

    Values and candidates are sorted together once, and candidates are counted as they pass, so neither is crossed with
    the other, and no list of candidates is carried along.
    """
    distinct = values.select(*scenario, "value").distinct().withColumn("asks", F.lit(1))
    given = candidates.select(*scenario, F.col("T").alias("value"), F.lit(0).alias("asks"))
    w = Window.partitionBy("_dealt", *scenario).orderBy("value", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = gathered([given, distinct], scenario).withColumn("r", F.count_if(F.col("asks") == 0).over(w).cast("int"))
    return both.where("asks = 1").select(*scenario, "value", "r")


def _intervals(ranked: DataFrame, filtering: str, matching: str) -> DataFrame:
    """(series_id, a, b, alert, matched, o, covers): what happens for candidates a < k <= b.

    alert and matched are 1 if an alert begins, and if it is one that meets an outbreak; covers: outbreak o is detected.
    """
    w = Window.partitionBy("series_id").orderBy("day")
    last = F.max(F.when(F.col("outbreak_idx").isNotNull(), F.col("day"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    days = ranked.withColumns({"before": F.coalesce(F.lag("r").over(w), F.lit(0)), "after": F.coalesce(F.lead("r").over(w), F.lit(0)), "fresh": ~F.col("outbreak_idx").eqNullSafe(F.lag("outbreak_idx").over(w)), "since": last})
    days = days.withColumn("least", F.min("r").over(Window.partitionBy("series_id", "since").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    # at an outbreak's first day: the lowest rank since the last outbreak's end, 0 before the first outbreak
    gap = F.when(F.lag("since").over(w).isNull(), F.lit(0)).otherwise(F.lag("least").over(w))
    days = days.withColumn("gap", gap)
    through = F.least("before", "r", "after")  # an alert is on the day before, the first day and the day after it
    inside, fresh = F.col("outbreak_idx").isNotNull(), F.col("fresh") & F.col("outbreak_idx").isNotNull()
    part = lambda a, b, alert, matched, covers: F.struct(a.alias("a"), b.alias("b"), F.lit(alert).alias("alert"), matched.cast("int").alias("matched"), covers.alias("covers"))
    found = [F.when(F.col("r") > F.col("before"), part(F.col("before"), F.col("r"), 1, inside, inside))]
    if filtering == ALL_ALERTS:
        found.append(F.when(fresh & (through > F.col("gap")), part(F.col("gap"), through, 0, F.lit(1), F.lit(matching == SINGLE))))
        if matching == MULTIPLE:
            found.append(F.when(fresh & (through > 0), part(F.lit(0), through, 0, F.lit(0), F.lit(True))))
    elif filtering != POST_START:
        raise ValueError(f"no such filter: {filtering}")
    rows = days.select("series_id", F.col("outbreak_idx").alias("o"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i"))
    return rows.select("series_id", "o", "i.*")


def candidate_counts(ready: DataFrame, candidates: list[float] | DataFrame, keys: list[str], by: list[str], filtering: str = ALL_ALERTS, matching: str = SINGLE) -> DataFrame:
    """(keys, T, n_alerts, n_outbreaks, n_matched_alerts, n_matched_outbreaks) of every series and candidate.

    ready: (keys, day, value, outbreak_idx), the last from runs.marked(). candidates: thresholds for all scenarios, or
    a written table (scenario, T), where the scenario is keys without `by`.
    """
    if matching not in (SINGLE, MULTIPLE):
        raise ValueError(f"no such matching: {matching}")
    scenario = [k for k in keys if k not in by]
    if isinstance(candidates, list):
        grid = sorted(map(float, candidates))
        days = ready.withColumn("r", rank(F.col("value"), grid))
    else:
        days = ready.join(merged_ranks(ready, candidates, scenario), [*scenario, "value"])
    ranked = days.select(F.xxhash64(*keys).alias("series_id"), "day", "outbreak_idx", "r").repartition("series_id")
    found = _intervals(ranked, filtering, matching)
    covered = F.max(F.when(F.col("covers"), F.col("b"))).over(Window.partitionBy("series_id", "o").orderBy("a", "b", "alert", "matched").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.greatest("a", F.coalesce(covered, F.lit(0))))
    new = (F.col("covers") & (F.col("b") > F.col("fresh"))).cast("int")
    end = lambda at, sign, alert, matched, new: F.struct((at + 1).alias("k"), (sign * alert).alias("n_alerts"), (sign * matched).alias("n_matched_alerts"), (sign * new).alias("n_matched_outbreaks"))
    none = F.lit(0)
    ends = F.array(end(F.col("a"), 1, F.col("alert"), F.col("matched"), none), end(F.col("fresh"), 1, none, none, new), end(F.col("b"), -1, F.col("alert"), F.col("matched"), new))
    steps = found.select("series_id", F.explode(ends).alias("e")).select("series_id", "e.*")
    names = ready.groupBy(*keys).agg(F.coalesce(F.max("outbreak_idx"), F.lit(0)).cast("long").alias("n_outbreaks")).withColumn("series_id", F.xxhash64(*keys))
    if isinstance(candidates, list):
        axis = names.select("series_id", F.posexplode(F.lit(grid)).alias("k", "T")).withColumn("k", F.col("k") + 1)
    else:
        numbered = candidates.select(*scenario, "T", F.row_number().over(Window.partitionBy(*scenario).orderBy("T")).alias("k"))
        axis = names.select(*scenario, "series_id").join(numbered, scenario).select("series_id", "k", "T")
    summed = steps.columns[2:]
    axis = axis.select("series_id", "k", *(F.lit(0).alias(c) for c in summed), "T")
    sums = gathered([steps, axis], ["series_id"]).groupBy("_dealt", "series_id", "k").agg(*(F.sum(c).alias(c) for c in summed), F.max("T").alias("T"))
    w = Window.partitionBy("_dealt", "series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    counts = sums.select("series_id", "T", *(F.sum(c).over(w).alias(c) for c in summed)).where("T is not null")
    return counts.join(names, "series_id").select(*keys, "T", "n_alerts", "n_outbreaks", "n_matched_alerts", "n_matched_outbreaks")


def mean_losses(counts: DataFrame, scenario: list[str], metrics: list[str]) -> DataFrame:
    """(scenario, accuracy_metric, T, mean_accuracy, loss): accuracy averaged over a scenario's series, for each metric."""
    each = counts.select("*", F.explode(F.lit(metrics)).alias("accuracy_metric"))
    ppv, detected = ratio(F.col("n_matched_alerts"), F.col("n_alerts")), ratio(F.col("n_matched_outbreaks"), F.col("n_outbreaks"))
    each = each.withColumn("accuracy", accuracy(F.col("accuracy_metric"), ppv, detected))
    return each.groupBy(*scenario, "accuracy_metric", "T").agg(F.round(F.avg("accuracy"), 9).alias("mean_accuracy")).withColumn("loss", F.round(1 - F.col("mean_accuracy"), 9))


def scores(ready: DataFrame, candidates: list[float] | DataFrame, keys: list[str], by: list[str], metric: str, filtering: str = ALL_ALERTS, matching: str = SINGLE) -> DataFrame:
    """(keys without by, T, mean_accuracy, loss) for one metric; see candidate_counts()."""
    scenario = [k for k in keys if k not in by]
    return mean_losses(candidate_counts(ready, candidates, keys, by, filtering, matching), scenario, [metric]).drop("accuracy_metric")


def best(scored: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario, T, loss): the lowest loss, the smallest T among equals; a T without any accuracy doesn't count."""
    pick = F.min(F.struct("loss", "T")).alias("_b")
    return scored.where("loss is not null").groupBy(*scenario).agg(pick).select(*scenario, "_b.T", "_b.loss")


def result_at(ready: DataFrame, chosen: DataFrame, series: DataFrame, outbreaks: DataFrame, keys: list[str], by: list[str], metric: str, filtering: str = ALL_ALERTS, matching: str = SINGLE) -> DataFrame:
    """The metric record of every series at its scenario's best T; chosen is a written table with a row a scenario."""
    scenario, each = [k for k in keys if k not in by], ["series_id", *by]
    names = series_names(ready, keys)
    at = beside(ready, chosen, scenario).where(F.col("value") >= F.col("T"))
    alerts = runs(at.select(F.xxhash64(*keys).alias("series_id"), *by, "day").repartition("series_id"), each, "alert_idx")
    own = names.select(*each).join(outbreaks, by)
    pairs = matches(alerts, own, each, None, filtering, matching)
    found = record(names.select(*each, "length"), series, alerts, own, pairs, each, metric, by)
    return beside(found.join(names.drop("length"), each), chosen, scenario)


def sweep_all(positives: DataFrame, candidates: list[float] | DataFrame, methods: list[str], metrics: list[str], keys: list[str], by: list[str]) -> DataFrame:
    """(scenario, alert_method, accuracy_metric, T, loss): the best T of every test, background, method and metric.

    A day's row is taken for each method, and the counts of a method serve every metric. Names and outbreak numbers of
    the series come from a second pass that leaves values and their windows out.
    """
    rows = positives.select("*", F.explode(F.lit(methods)).alias("alert_method"))
    ready = rows.select(*keys, "alert_method", "day", "outbreak_idx", compared(F.col("alert_method")).alias("value"))
    scenario = [*(k for k in keys if k not in by), "alert_method"]
    counts = candidate_counts(ready, candidates, [*keys, "alert_method"], by)
    return best(mean_losses(counts, scenario, metrics), [*scenario, "accuracy_metric"])


def resume(
    spark: SparkSession, scenarios: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoints: str, run_ts: str, keys: list[str],
    batches: int = 5, expected: StructType | None = None, policy: str = "continue",
) -> DataFrame:
    """Compute what the store lacks in batches, save all as a new snapshot, clear checkpoints. compute: scenarios -> results.

    Scenarios fall into `batches` by a hash of their keys, and a batch is a checkpoint, named by its scenarios, as soon
    as it is computed; so a run that ends early loses one batch, and the next one, under whatever run_ts and with
    whatever batches, takes the checkpoints that no snapshot contains as results. Each key comes from one place: the
    newest snapshot, else the checkpoint written last. A scenario may have several result rows. A run_ts that the store
    has is refused before anything is computed. expected and policy pass stored folders through the schema gate.
    """
    if has_snapshot(spark, path, run_ts):
        raise ValueError(f"the store has a snapshot of {run_ts}")
    old = load_snapshot(spark, path, expected, policy)
    taken = frozenset() if old is None else contained(spark, path)
    begun = load_checkpoints(spark, checkpoints, keys, expected, policy, taken)
    todo = scenarios
    for done in (old, begun):
        todo = todo if done is None else missing(todo, done, keys)
    todo = todo.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int"))
    for number, digest in todo.groupBy("_batch").agg(batch_digest(keys)).orderBy("_batch").collect():  # at most `batches` rows
        append_checkpoint(compute(todo.where(F.col("_batch") == number).drop("_batch")), checkpoints, run_ts, number, keys, digest)
    new = load_checkpoints(spark, checkpoints, keys, expected, policy, taken)
    if old is None or new is None:
        results = old if new is None else new
    else:
        results = merged(old, missing(new, old, keys))
    compact(compute(todo.drop("_batch")) if results is None else results, path, run_ts, checkpoints)
    return load_snapshot(spark, path)
