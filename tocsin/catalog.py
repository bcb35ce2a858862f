"""Registered queries of the surveillance operators and the SQL that checks them.

Every query reads the given tables. Daily series are order lines by supplier region and ship date: returned lines are
the signal, others the background. Scenario and report tables are derived from order lines, parameters from parts.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tocsin.functions import labels, parameters as par
from tocsin.operators import matching as mt
from tocsin.operators import metrics as me
from tocsin.operators import runs as rn
from tocsin.operators import series as se
from tocsin.operators import slices as sl
from tocsin.operators import testing as te
from tocsin.plans import reports as rp
from tocsin.plans import scenarios as sc
from tocsin.plans import sweep as sw
from tocsin.sources import results as st
from tocsin.sources import series as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


SIM = ["sim"]
ONE_TEST = [te.TestSpec(0.9, 0.85, 0)]
TESTS = [te.TestSpec(0.85, 0.85, 0), te.TestSpec(0.9, 0.9, 0), te.TestSpec(1.0, 1.0, 0), te.TestSpec(1.0, 1.0, 14)]
RATES = [0.4, 1.0]
METHODS = ["DailyThreshold", "MovingAverage", "DailyThresholdMovingAverage"]


# Series, outbreaks, alerts and matches that many queries share ------------------------------------------------------

def _series(spark: SparkSession, d: str) -> DataFrame:
    return src.line_series(spark, d, partial(_kept, spark))


def _spec_of(mean: float) -> rn.OutbreakSpec:
    t = math.ceil(mean)
    return rn.OutbreakSpec(t, 3, 4 * t)


def _spec(series: DataFrame) -> rn.OutbreakSpec:
    return _spec_of(series.agg(F.avg("incidence")).first()[0])


def _positives(series: DataFrame) -> DataFrame:
    return se.with_alert_inputs(te.expected_positives(series, [1.0], ONE_TEST, SIM), SIM)


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a written table, so that what reads it more than once computes it once."""
    path = _store(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sims(series: DataFrame) -> DataFrame:
    return series.groupBy("sim").agg(F.count("*").cast("int").alias("length"))


def _world(spark: SparkSession, d: str, filtering: str = mt.ALL_ALERTS, match: str = mt.SINGLE):
    """series, positives, alerts, outbreaks, pairs, series keys with lengths."""
    series = _kept(spark, _series(spark, d))
    positives = _positives(series).select("sim", "day", "test_pos", "test_pos_ma")
    means = series.agg(F.avg("incidence"), F.avg(te.test_positives(F.col("incidence"), F.col("noise"), 1.0, ONE_TEST[0]))).first()
    spec, t = _spec_of(means[0]), math.ceil(means[1])
    alerts = rn.runs(positives.where(rn.alert_flag(F.col("test_pos_ma"), F.lit(float(t)))).select("sim", "day"), SIM, "alert_idx")
    outbreaks = rn.outbreaks(series, spec, SIM)
    pairs = mt.matches(alerts, outbreaks, SIM, None, filtering, match)
    return series, positives, alerts, outbreaks, pairs, _sims(series)


S_SERIES = """WITH lines AS (
  SELECT n_regionkey AS sim, CAST(l_shipdate AS DATE) AS date, l_returnflag = 'R' AS returned
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ends AS (SELECT min(date) AS first, date_diff('day', min(date), max(date)) + 1 AS n FROM lines),
counts AS (
  SELECT sim, CAST(date_diff('day', first, date) + 1 AS INTEGER) AS day, count(*) FILTER (WHERE returned) AS incidence, count(*) FILTER (WHERE NOT returned) AS noise
  FROM lines, ends GROUP BY 1, 2),
days AS (SELECT CAST(unnest(range(1, n + 1)) AS INTEGER) AS day FROM ends),
series AS (
  SELECT r_regionkey AS sim, days.day, coalesce(incidence, 0) AS incidence, coalesce(noise, 0) AS noise
  FROM region CROSS JOIN days LEFT JOIN counts ON counts.sim = r_regionkey AND counts.day = days.day)"""
S_OUT = S_SERIES + """,
spec AS (SELECT ceil(avg(incidence)) AS thr FROM series),
oflag AS (SELECT sim, day, incidence, day - row_number() OVER (PARTITION BY sim ORDER BY day) AS island FROM series, spec WHERE incidence >= thr),
oruns AS (SELECT sim, island, min(day) AS lo, max(day) AS hi, count(*) AS duration, CAST(sum(incidence) AS BIGINT) AS size FROM oflag GROUP BY sim, island),
outbreaks AS (
  SELECT sim, CAST(row_number() OVER (PARTITION BY sim ORDER BY lo) AS INTEGER) AS outbreak_idx, lo, hi, duration, size
  FROM oruns, spec WHERE duration >= 3 AND size >= 4 * thr)"""
S_POS = S_OUT + """,
pos AS (
  SELECT sim, day, incidence, noise, CAST(round_even(incidence * CAST(0.9 AS DOUBLE), 0) AS BIGINT) AS true_pos,
    CAST(round_even(noise * (1 - CAST(0.85 AS DOUBLE)), 0) AS BIGINT) AS false_pos FROM series),
ma AS (
  SELECT sim, day, true_pos + false_pos AS test_pos,
    avg(true_pos + false_pos) OVER (PARTITION BY sim ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS test_pos_ma FROM pos)"""
S_ALERT = S_POS + """,
thr AS (SELECT ceil(avg(test_pos)) AS t FROM ma),
aflag AS (SELECT sim, day, day - row_number() OVER (PARTITION BY sim ORDER BY day) AS island FROM ma, thr WHERE test_pos_ma >= t),
aruns AS (SELECT sim, island, min(day) AS lo, max(day) AS hi, count(*) AS duration FROM aflag GROUP BY sim, island),
alerts AS (SELECT sim, CAST(row_number() OVER (PARTITION BY sim ORDER BY lo) AS INTEGER) AS alert_idx, lo, hi, duration FROM aruns),
met AS (
  SELECT a.sim, outbreak_idx, alert_idx, a.lo AS alert_lo, o.lo AS outbreak_lo,
    row_number() OVER (PARTITION BY a.sim, alert_idx ORDER BY outbreak_idx) AS n
  FROM alerts a JOIN outbreaks o ON a.sim = o.sim AND ((a.lo >= o.lo AND a.lo <= o.hi) OR (a.lo <= o.lo AND a.hi > o.lo))),
pairs AS (SELECT sim, outbreak_idx, alert_idx, alert_lo, outbreak_lo FROM met WHERE n = 1),
firsts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sim, outbreak_idx ORDER BY alert_idx) AS k FROM pairs) WHERE k = 1),
sims AS (SELECT r_regionkey AS sim FROM region),
tallies AS (
  SELECT sim, (SELECT count(*) FROM alerts a WHERE a.sim = s.sim) AS n_alerts, (SELECT count(*) FROM outbreaks o WHERE o.sim = s.sim) AS n_outbreaks,
    (SELECT count(DISTINCT alert_idx) FROM pairs p WHERE p.sim = s.sim) AS n_matched_alerts,
    (SELECT count(DISTINCT outbreak_idx) FROM pairs p WHERE p.sim = s.sim) AS n_matched_outbreaks FROM sims s),
rates AS (SELECT *, n_matched_outbreaks / nullif(n_outbreaks, 0) AS detected, n_matched_alerts / nullif(n_alerts, 0) AS ppv FROM tallies),
acc AS (
  SELECT *, (coalesce(ppv, 0) + coalesce(detected, 0)) / nullif((ppv IS NOT NULL)::INT + (detected IS NOT NULL)::INT, 0) AS balanced,
    coalesce(2 * ppv * detected / nullif(ppv + detected, 0), 0) AS f1 FROM rates),
upto AS (SELECT sim, day, sum(incidence) OVER (PARTITION BY sim ORDER BY day) AS upto FROM series),
avoid AS (
  SELECT o.sim, o.outbreak_idx, CAST(coalesce(u.upto, 0) - coalesce(b.upto, 0) AS BIGINT) AS cases
  FROM outbreaks o LEFT JOIN firsts f ON f.sim = o.sim AND f.outbreak_idx = o.outbreak_idx
  LEFT JOIN upto b ON b.sim = o.sim AND b.day = o.lo - 1
  LEFT JOIN upto u ON u.sim = o.sim AND u.day = CASE WHEN f.alert_lo IS NULL THEN o.hi ELSE greatest(f.alert_lo, o.lo) - 1 END)"""


# Sources -----------------------------------------------------------------------------------------------------------

@_q("s1_count_series", S_SERIES + " SELECT sim, day, incidence, noise FROM counts")
def _(spark, d):
    return src.line_counts(spark, d, partial(_kept, spark))


@_q("s2_dense_days", S_SERIES + " SELECT * FROM series")
def _(spark, d):
    return _series(spark, d)


@_q("s2_dense_event_hours", """WITH e AS (SELECT event_type AS sim, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour FROM events),
ends AS (SELECT min(hour) AS first, date_diff('hour', min(hour), max(hour)) + 1 AS n FROM e),
c AS (SELECT sim, CAST(date_diff('hour', first, hour) + 1 AS INTEGER) AS day, count(*) AS incidence FROM e, ends GROUP BY 1, 2)
SELECT s.sim, x.day, coalesce(c.incidence, 0) AS incidence FROM (SELECT DISTINCT sim FROM e) s CROSS JOIN (SELECT CAST(unnest(range(1, n + 1)) AS INTEGER) AS day FROM ends) x
LEFT JOIN c ON c.sim = s.sim AND c.day = x.day""")
def _(spark, d):
    return src.event_series(spark, d, partial(_kept, spark))


def _store(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/store-{uuid.uuid4().hex}"


REPORT_KEYS = ["noise_type", "noise_level", "sensitivity", "specificity", "test_lag", "percent_tested"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as measured values of report scenarios."""
    test = F.element_at(F.array(*(F.struct(F.lit(t.sensitivity).alias("sensitivity"), F.lit(t.specificity).alias("specificity"), F.lit(t.test_lag).alias("test_lag")) for t in TESTS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.when(F.col("l_linestatus") == "O", "static").otherwise("dynamic").alias("noise_type"), F.col("l_linenumber").cast("double").alias("noise_level"), test.alias("t"),
        (F.round(F.col("l_discount") * 100).cast("int") / 10).alias("percent_tested"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"),
    )
    return rows.select("noise_type", "noise_level", "t.*", "percent_tested", "value", "l_orderkey", "l_linenumber", "year")


def _report(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(*REPORT_KEYS).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


S_LINES = """WITH tests(k, sensitivity, specificity, test_lag) AS (VALUES (0, CAST(0.85 AS DOUBLE), CAST(0.85 AS DOUBLE), 0), (1, 0.9, 0.9, 0), (2, 1.0, 1.0, 0), (3, 1.0, 1.0, 14)),
lines AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'dynamic' END AS noise_type, CAST(l_linenumber AS DOUBLE) AS noise_level, sensitivity, specificity, test_lag,
    CAST(round(l_discount * 100) AS INTEGER) / CAST(10 AS DOUBLE) AS percent_tested, l_quantity AS value, l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year
  FROM lineitem JOIN tests ON k = l_suppkey % 4)"""
S_REPORT = S_LINES + """,
report AS (
  SELECT noise_type, noise_level, sensitivity, specificity, test_lag, percent_tested, avg(value) AS value, count(*) AS n
  FROM lines GROUP BY ALL)"""


@_q("s3_save_results", S_REPORT + " SELECT * FROM report")
def _(spark, d):
    path = _store(spark)
    st.save_results(_report(spark, d), path, "2024-01-01T00-00-00")
    return st.stored(spark, path).drop(*st.SNAPSHOT, st.FINGERPRINT)


@_q("s4_checkpoint_append", S_REPORT + " SELECT *, CASE WHEN noise_level <= 2 THEN 'first' ELSE 'second' END AS run_id, CAST(noise_level AS INTEGER) % 2 AS batch FROM report")
def _(spark, d):
    path, report = _store(spark), _kept(spark, _report(spark, d))
    for run, rows in (("first", report.where("noise_level <= 2")), ("second", report.where("noise_level > 2"))):
        for batch in (0, 1):  # both runs have batches of the same numbers
            for _ in range(2):  # a retry under the same name finds the batch there
                st.append_checkpoint(rows.where(F.col("noise_level") % 2 == batch), path, run, batch, REPORT_KEYS)
    return st.stored(spark, path).drop("written", st.FINGERPRINT)


@_q("s5_latest_snapshot", S_REPORT + " SELECT * FROM report")
def _(spark, d):
    path, report = _store(spark), _kept(spark, _report(spark, d))
    st.save_results(report.where("noise_level <= 2"), path, "2024-01-01T00-00-00")
    st.save_results(report, path, "2024-03-01T00-00-00")
    return st.latest(st.stored(spark, path)).drop(*st.SNAPSHOT, st.FINGERPRINT)


@_q("s6_load_with_fallback", S_REPORT + " SELECT * REPLACE (CASE WHEN noise_level >= 2 THEN -value ELSE value END AS value) FROM report")
def _(spark, d):
    path, report = _store(spark), _kept(spark, _report(spark, d))
    st.append_checkpoint(report.where("noise_level <= 2"), f"{path}/checkpoints", "run", 1, REPORT_KEYS)
    st.append_checkpoint(report.where("noise_level >= 2").withColumn("value", -F.col("value")), f"{path}/checkpoints", "run", 2, REPORT_KEYS)
    return st.load_results(spark, f"{path}/results", f"{path}/checkpoints", REPORT_KEYS)


@_q("s7_compaction", S_REPORT + " SELECT * FROM report")
def _(spark, d):
    path, report = _store(spark), _kept(spark, _report(spark, d))
    st.append_checkpoint(report.where("noise_level <= 3"), f"{path}/checkpoints", "run", 1, REPORT_KEYS)
    st.append_checkpoint(report.where("noise_level > 3"), f"{path}/checkpoints", "run", 2, REPORT_KEYS)
    st.compact(st.load_results(spark, f"{path}/results", f"{path}/checkpoints", REPORT_KEYS), f"{path}/results", "2024-05-01T00-00-00", f"{path}/checkpoints")
    return st.load_results(spark, f"{path}/results", f"{path}/checkpoints", REPORT_KEYS)


@_q("s8_schema_gate", S_REPORT + " SELECT 'continue' AS policy, count(*) AS n FROM report UNION ALL SELECT 'force', 0 UNION ALL SELECT 'matching', count(*) FROM report UNION ALL SELECT 'widened', count(*) FROM report UNION ALL SELECT 'other type', 0")
def _(spark, d):
    path, report = _store(spark), _kept(spark, _report(spark, d))
    st.save_results(report, f"{path}/results", "2024-01-01T00-00-00")
    count = lambda policy, df: df.agg(F.lit(policy).alias("policy"), F.count("*").alias("n"))
    load = lambda expected, policy: st.load_results(spark, f"{path}/results", f"{path}/checkpoints", REPORT_KEYS, expected, policy)
    own = report.schema
    typed = lambda kind: StructType([StructField(f.name, DoubleType() if kind == "wide" else StringType()) if f.name == "test_lag" else f for f in own.fields])
    none = spark.createDataFrame([], own)
    asked = {"continue": (StructType([*own.fields, StructField("more", StringType())]), "continue"), "force": (typed("wide"), "force"), "matching": (own, "quit"), "widened": (typed("wide"), "continue"), "other type": (typed("text"), "continue")}
    out = [count(name, none if (found := load(*how)) is None else found) for name, how in asked.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@_q("s9_csv_export", S_REPORT + " SELECT noise_type, sensitivity, specificity, test_lag, percent_tested, n FROM report")
def _(spark, d):
    path = _store(spark)
    st.export_csv(_report(spark, d).drop("value"), path)
    return spark.read.option("header", True).schema("noise_type string, sensitivity double, specificity double, test_lag int, percent_tested double, n long").csv(path)


# Scenario grid -----------------------------------------------------------------------------------------------------

def _grid(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("ensemble"))
    types = lines.select(F.when(F.col("l_linestatus") == "O", "static").otherwise("dynamic").alias("noise_type")).distinct()
    levels = lines.select(F.col("l_linenumber").cast("double").alias("noise_level")).distinct()
    tests = spark.createDataFrame([tuple(t) for t in TESTS], "sensitivity double, specificity double, test_lag int")
    percents = lines.select((F.round(F.col("l_discount") * 100).cast("int") / 10).alias("percent_tested")).distinct()
    methods = spark.createDataFrame([("DailyThreshold", None), ("MovingAverage", 7)], "alert_method string, alert_window int")
    return sc.grid([regions, types, levels, tests, percents, methods])


GRID_KEYS = ["ensemble", "noise_type", "noise_level", "sensitivity", "specificity", "test_lag", "percent_tested", "alert_method", "alert_window"]
S_GRID = """WITH tests(sensitivity, specificity, test_lag) AS (VALUES (CAST(0.85 AS DOUBLE), CAST(0.85 AS DOUBLE), 0), (0.9, 0.9, 0), (1.0, 1.0, 0), (1.0, 1.0, 14)),
methods(alert_method, alert_window) AS (VALUES ('DailyThreshold', NULL), ('MovingAverage', 7)),
grid AS (
  SELECT CAST(row_number() OVER (ORDER BY alert_method, percent_tested, sensitivity, specificity, test_lag, noise_level, noise_type, ensemble) AS INTEGER) AS ord,
    ensemble, noise_type, noise_level, sensitivity, specificity, test_lag, percent_tested, alert_method, CAST(alert_window AS INTEGER) AS alert_window
  FROM (SELECT r_name AS ensemble FROM region)
  CROSS JOIN (SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'dynamic' END AS noise_type FROM lineitem)
  CROSS JOIN (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS noise_level FROM lineitem) CROSS JOIN tests
  CROSS JOIN (SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) / CAST(10 AS DOUBLE) AS percent_tested FROM lineitem) CROSS JOIN methods)"""


def _completed(grid: DataFrame) -> DataFrame:
    done = grid.where("ord % 3 = 0")
    return done.union(done.where("ord % 2 = 0"))


@_q("p1_scenario_grid", S_GRID + " SELECT * FROM grid")
def _(spark, d):
    return _grid(spark, d)


@_q("p2_validity", S_GRID + """, x AS (SELECT ord, percent_tested * 1.5 AS p, noise_level - 2 AS level FROM grid)
SELECT ord, CAST((p > 1)::INT + (level < 0)::INT AS INTEGER) AS n_violations FROM x WHERE p > 1 OR level < 0""")
def _(spark, d):
    rows = _grid(spark, d).withColumns({"percent_tested": F.col("percent_tested") * 1.5, "noise_level": F.col("noise_level") - 2, "threshold_lower": F.lit(0.0), "threshold_upper": F.lit(50.0)})
    return rows.select("ord", F.size(sc.violations(**sc.scenario_rules())).alias("n_violations")).where("n_violations > 0")


@_q("p2_dynamics_validity", """WITH x AS (
  SELECT p_partkey AS id, p_size - 3 AS r0, p_size % 7 - 1 AS latent, 3 - p_partkey % 4 AS infectious, (p_partkey % 13) / CAST(10 AS DOUBLE) AS most, (p_partkey % 5) / CAST(4 AS DOUBLE) - 0.25 AS least,
    (p_partkey % 9) / CAST(7 AS DOUBLE) AS force, p_partkey % 6 AS n, ['none', 'in-phase', 'out-of-phase', 'other'][p_partkey % 4 + 1] AS correlation, p_partkey % 8 AS tmax, (p_partkey % 3) - 1 AS tstep FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN r0 <= 0 THEN 'r0' END, CASE WHEN latent <= 0 THEN 'latent' END, CASE WHEN infectious <= 0 THEN 'infectious' END,
  CASE WHEN least < 0 OR least > most OR most > 1 THEN 'vaccination' END, CASE WHEN force < 0 OR force > 1 THEN 'force' END, CASE WHEN n <= 0 THEN 'population' END,
  CASE WHEN correlation = 'other' THEN 'correlation' END, CASE WHEN tmax <= 1 + tstep THEN 'time' END, CASE WHEN tstep <= 0 THEN 'tstep' END], lambda v: v IS NOT NULL), ',') AS broken FROM x""")
def _(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("id"), (F.col("p_size") - 3).alias("r0"), (F.col("p_size") % 7 - 1).alias("latent"), (3 - k % 4).alias("infectious"), ((k % 13) / 10).alias("max_vaccination"), ((k % 5) / 4 - 0.25).alias("min_vaccination"),
        ((k % 9) / 7).alias("force"), (k % 6).alias("n"), F.element_at(F.array(*map(F.lit, ("none", "in-phase", "out-of-phase", "other"))), (k % 4 + 1).cast("int")).alias("correlation"),
        F.lit(1).alias("tmin"), (k % 8).alias("tmax"), (k % 3 - 1).alias("tstep"),
    )
    return rows.select("id", F.array_join(sc.violations(**sc.dynamics_rules()), ",").alias("broken"))


@_q("p3_scenario_key", S_GRID + """ SELECT ord, sha256(to_json(struct_pack(ensemble := ensemble || '|-', noise_level := noise_level, noise_type := noise_type, sensitivity := sensitivity, specificity := specificity, test_lag := test_lag,
percent_tested := percent_tested, alert_method := alert_method, alert_window := alert_window, accuracy_metric := 'F1', threshold_lower := CAST(0 AS DOUBLE), threshold_upper := CAST(50 AS DOUBLE), outbreak_threshold := 5,
min_duration := 30, min_size := 500, alert_filtering := CASE WHEN ord % 2 = 0 THEN '-' END, alert_matching := 'SingleOutbreakPerAlert'))) AS scenario_id FROM grid""")
def _(spark, d):
    rows = _grid(spark, d).withColumns({
        "ensemble": F.concat("ensemble", F.lit("|-")), "accuracy_metric": F.lit("F1"), "threshold_lower": F.lit(0.0), "threshold_upper": F.lit(50.0), "outbreak_threshold": F.lit(5), "min_duration": F.lit(30),
        "min_size": F.lit(500), "alert_filtering": F.when(F.col("ord") % 2 == 0, "-"), "alert_matching": F.lit(mt.SINGLE),
    })
    return rows.select("ord", sc.scenario_id(sc.SCENARIO_KEYS).alias("scenario_id"))


@_q("p4_missing_scenarios", S_GRID + " SELECT * FROM grid WHERE ord % 3 <> 0")
def _(spark, d):
    grid = _grid(spark, d)
    return sc.missing(grid, _completed(grid), GRID_KEYS)


@_q("p5_completed_keys", S_GRID + " SELECT * EXCLUDE (ord) FROM grid WHERE ord % 3 = 0")
def _(spark, d):
    return sc.completed_keys(_completed(_grid(spark, d)), GRID_KEYS)


@_q("p6_group_by_properties", S_GRID + " SELECT noise_type, noise_level, count(*) AS n, min(ord) AS first FROM grid GROUP BY ALL")
def _(spark, d):
    return sc.grouped(_grid(spark, d), ["noise_type", "noise_level"])


@_q("p7_merge_results", S_REPORT + " SELECT *, CASE WHEN noise_level > 3 THEN 'new' END AS tag FROM report")
def _(spark, d):
    report = _report(spark, d)
    return sc.merged(report.where("noise_level <= 3"), report.where("noise_level > 3").withColumn("tag", F.lit("new")))


@_q("p8_run_cost", S_GRID + " SELECT count(*) AS n, count(*) * CAST(1.7 AS DOUBLE) AS seconds, count(*) * 1.7 > 300 AS long_run FROM grid WHERE ord % 3 <> 0")
def _(spark, d):
    grid = _grid(spark, d)
    return sc.run_cost(sc.missing(grid, _completed(grid), GRID_KEYS))


@_q("p9_path_key", S_GRID + " SELECT ord, concat_ws('/', 'type_' || noise_type, 'level_' || CAST(CAST(noise_level AS INTEGER) AS VARCHAR), 'lag_' || CAST(test_lag AS VARCHAR), 'method_' || alert_method) AS path FROM grid")
def _(spark, d):
    return _grid(spark, d).select("ord", labels.path_key(type=F.col("noise_type"), level=F.col("noise_level").cast("int"), lag=F.col("test_lag"), method=F.col("alert_method")).alias("path"))


@_q("p10_labels", S_GRID + """ SELECT ord, CASE WHEN noise_type = 'static' THEN 'Poisson' ELSE 'Dynamical, in-phase' END AS noise, regexp_extract('AlertMethod.' || alert_method || '(7)', '([^.(]+)\\(', 1) AS method,
CASE WHEN noise_type = 'static' THEN 'Poisson scaling: ' || CAST(noise_level AS VARCHAR) ELSE 'Vaccination coverage: ' || CAST(percent_tested AS VARCHAR) END AS magnitude FROM grid""")
def _(spark, d):
    shown = F.concat(F.lit("AlertMethod."), "alert_method", F.lit("(7)"))
    magnitude = labels.noise_magnitude(F.col("noise_type"), F.col("noise_level"), F.col("percent_tested"))
    return _grid(spark, d).select("ord", labels.noise_description(F.col("noise_type"), F.lit("in-phase")).alias("noise"), labels.method_name(shown).alias("method"), magnitude.alias("magnitude"))


@_q("p11_test_labels", S_GRID + """ SELECT ord, CASE WHEN sensitivity = 1 THEN 'Perfect test (' || test_lag || ' day lag)' ELSE 'RDT-like (' || CAST(sensitivity * 100 AS VARCHAR) || '% sens/spec)' END AS description,
CASE WHEN sensitivity = 1 THEN 'Perfect Test' ELSE 'Imperfect Test (' || CAST(round_even(sensitivity * 100, 0) AS INTEGER) || '%)' END AS in_table,
CASE WHEN sensitivity = 1 THEN 'Perfect Test (' || test_lag || '-day lag)' ELSE 'Imperfect Test (' || CAST(round_even(sensitivity * 100, 0) AS INTEGER) || '%)' END AS in_plot FROM grid""")
def _(spark, d):
    test = [F.col(c) for c in rp.SPEC]
    return _grid(spark, d).select("ord", labels.test_description(*test).alias("description"), labels.table_label(*test).alias("in_table"), labels.plot_label(*test).alias("in_plot"))


@_q("p12_noise_label", """SELECT event_id, CASE WHEN event_type IN ('static', 'poisson') THEN 'Static Noise' WHEN event_type IN ('dynamic', 'dynamical_inphase') THEN 'Dynamical Noise'
ELSE array_to_string(list_transform(string_split(event_type || '_noise', '_'), lambda w: upper(w[1]) || lower(w[2:])), '_') END AS label FROM events""")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", labels.noise_label(F.concat("event_type", F.lit("_noise"))).alias("label"))


# Parameters --------------------------------------------------------------------------------------------------------

def _params(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("id"), (2 + F.col("p_size") / 4).alias("r0"), (1 + F.col("p_size") % 12).alias("latent"), (3 + F.col("p_size") % 9).alias("infectious"), (10 + k % 30).alias("births"),
        (1000 * (1 + k % 500)).alias("n"), ((k % 11) / 10).alias("coverage"), ((k % 5) / 10).alias("force"), (k % 365).alias("day"),
        F.when(k % 2 == 0, "sine").otherwise("cosine").alias("shape"), F.element_at(F.array(*map(F.lit, ("none", "in-phase", "out-of-phase"))), (k % 3 + 1).cast("int")).alias("correlation"),
    )
    rows = rows.withColumns({"sigma": par.rate(F.col("latent")), "gamma": par.rate(F.col("infectious")), "mu": par.birth_rate(F.col("births"))})
    rows = rows.withColumn("beta", par.transmission(*map(F.col, ("r0", "sigma", "gamma", "mu"))))
    state = par.equilibrium(*map(F.col, ("r0", "beta", "sigma", "gamma", "mu", "coverage")))
    return rows.withColumn("state", state)


S_PAR = """WITH p0 AS (
  SELECT p_partkey AS id, 2 + p_size / CAST(4 AS DOUBLE) AS r0, 1 + p_size % 12 AS latent, 3 + p_size % 9 AS infectious, 10 + p_partkey % 30 AS births, 1000 * (1 + p_partkey % 500) AS n,
    (p_partkey % 11) / CAST(10 AS DOUBLE) AS coverage, (p_partkey % 5) / CAST(10 AS DOUBLE) AS force, p_partkey % 365 AS day, CASE WHEN p_partkey % 2 = 0 THEN 'sine' ELSE 'cosine' END AS shape,
    ['none', 'in-phase', 'out-of-phase'][p_partkey % 3 + 1] AS correlation FROM part),
p1 AS (SELECT *, 1 / CAST(latent AS DOUBLE) AS sigma, 1 / CAST(infectious AS DOUBLE) AS gamma, 1 / ((1000 / CAST(births AS DOUBLE)) * 365) AS mu FROM p0),
p AS (SELECT *, r0 * (sigma + mu) * (gamma + mu) / sigma AS beta FROM p1),
q0 AS (SELECT *, r0 * (1 - coverage) AS reff, 1 / r0 AS s_, mu * (r0 * (1 - coverage) - 1) / beta AS i_ FROM p),
q1 AS (SELECT *, i_ * (gamma + mu) / sigma AS e_ FROM q0), q2 AS (SELECT *, 1 - s_ - e_ - i_ AS r_ FROM q1),
q AS (SELECT *, CASE WHEN coverage < 0 OR coverage > 1 THEN 'coverage' WHEN reff <= 1 THEN 'no endemic state' WHEN r_ < 0 THEN 'negative' ELSE 'ok' END AS status FROM q2)"""


def _scalar(name: str, sql: str | dict[str, str], column: Callable[[], Column | dict[str, Column]]) -> None:
    named = sql if isinstance(sql, dict) else {"x": sql}

    @_q(name, f"{S_PAR} SELECT id, {', '.join(f'round({x}, 9) AS {n}' for n, x in named.items())} FROM q")
    def _(spark, d):
        found = column()
        found = found if isinstance(found, dict) else {"x": found}
        return _params(spark, d).select("id", *(F.round(x, 9).alias(n) for n, x in found.items()))


_c = F.col
_scalar("e1_exit_rates", {"sigma": "sigma", "gamma": "gamma"}, lambda: {"sigma": _c("sigma"), "gamma": _c("gamma")})
_scalar("e2_birth_rate", "mu", lambda: _c("mu"))
_scalar("e3_transmission", "beta", lambda: _c("beta"))
_scalar("e4_reproduction", "(beta * 2) * sigma / ((sigma + mu) * (gamma + mu))", lambda: par.reproduction(_c("beta") * 2, _c("sigma"), _c("gamma"), _c("mu")))
_scalar("e5_import_rate", "CAST(1.06 AS DOUBLE) * mu * (r0 - 1) / sqrt(n)", lambda: par.import_rate(_c("mu"), _c("r0"), _c("n")))
_scalar("e6_seasonal", "beta * (1 + force * CASE WHEN shape = 'sine' THEN sin(2 * pi() * day / 365) ELSE cos(2 * pi() * day / 365) END)", lambda: par.seasonal(_c("beta"), _c("force"), _c("day"), _c("shape")))
_scalar("e7_effective", {"by_state": "r0 * (n * 0.4) / n", "by_coverage": "r0 * (1 - coverage)"}, lambda: {"by_state": par.effective(_c("r0"), _c("n") * 0.4, _c("n")), "by_coverage": _c("r0") * (1 - _c("coverage"))})
_scalar("e10_background", {"force": "CASE WHEN correlation = 'none' THEN 0 ELSE force END", "turned": "CASE WHEN (correlation = 'out-of-phase') = (shape = 'sine') THEN CAST(1 AS DOUBLE) ELSE 0 END",
         "beta": "(r0 / 2 + 1) * (sigma + mu) * (gamma + mu) / sigma", "epsilon": "CAST(1.06 AS DOUBLE) * mu * (r0 / 2 + 1 - 1) / sqrt(n)"}, lambda: _background())
_scalar("e11_background_start", {"s": "CASE WHEN status = 'ok' THEN s_ ELSE 1 - coverage END", "e": "CASE WHEN status = 'ok' THEN e_ ELSE 0 END", "i": "greatest(CASE WHEN status = 'ok' THEN i_ ELSE 0 END, 5 / CAST(n AS DOUBLE))",
         "r": "CASE WHEN status = 'ok' THEN r_ ELSE coverage END"}, lambda: {k: par.background_start(_c("state"), _c("coverage"), _c("n"))[k] for k in "seir"})


S_DAYS = S_SERIES + ", " + S_PAR.removeprefix("WITH ") + """,
onday AS (
  SELECT sim, s.day, incidence, sigma, gamma, mu, q.n, beta * (1 + force * CASE WHEN shape = 'sine' THEN sin(2 * pi() * s.day / 365) ELSE cos(2 * pi() * s.day / 365) END) AS beta_t
  FROM series s JOIN q ON q.id = sim + 1)"""


def _seasonal_days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A region's series has the parameters of the part numbered after it, on every day of its own."""
    series = _kept(spark, _series(spark, d))
    rows = _params(spark, d).drop("day").withColumn("sim", (F.col("id") - 1).cast("int"))
    return series, par.seasonal_series(rows, series.groupBy("sim").agg(F.min("day").alias("first"), F.max("day").alias("last")), SIM)


@_q("e6_seasonal_series", S_DAYS + " SELECT sim, day, round(beta_t, 9) AS beta_t FROM onday")
def _(spark, d):
    return _seasonal_days(spark, d)[1].select("sim", "day", _r("beta_t", 9).alias("beta_t"))


@_q("e7_effective_series", S_DAYS + """ SELECT sim, day, round((beta_t * sigma / ((sigma + mu) * (gamma + mu))) * (greatest(n - sum(incidence) OVER (PARTITION BY sim ORDER BY day), 0)) / n, 9) AS reff FROM onday""")
def _(spark, d):
    series, days = _seasonal_days(spark, d)
    upto = F.sum("incidence").over(se.by_day(SIM))
    states = series.join(days.select("sim", "n").distinct(), "sim").select("sim", "day", F.greatest(F.col("n") - upto, F.lit(0)).alias("susceptible"))
    return par.effective_series(days, states, SIM).select("sim", "day", _r("reff", 9).alias("reff"))


def _background() -> dict[str, Column]:
    """A background of another R0 than the series': its force, whether its season is a cosine, its beta and imports."""
    r0 = _c("r0") / 2 + 1
    cosine = (par.background_shape(_c("shape"), _c("correlation")) == "cosine").cast("double")
    return {"force": par.background_force(_c("force"), _c("correlation")), "turned": cosine, "beta": par.transmission(r0, _c("sigma"), _c("gamma"), _c("mu")), "epsilon": par.import_rate(_c("mu"), r0, _c("n"))}


@_q("e8_equilibrium", S_PAR + " SELECT id, status, CASE WHEN status = 'ok' THEN round(s_, 9) END AS s, CASE WHEN status = 'ok' THEN round(e_, 9) END AS e, CASE WHEN status = 'ok' THEN round(i_, 9) END AS i, CASE WHEN status = 'ok' THEN round(r_, 9) END AS r FROM q")
def _(spark, d):
    return _params(spark, d).select("id", "state.status", *(F.round(F.col("state")[x], 9).alias(x) for x in "seir"))


@_q("e9_initial_counts", S_PAR + " SELECT id, CAST(round_even(coverage * 0.5 * n, 0) AS BIGINT) AS s, CAST(round_even(0.015625 * n, 0) AS BIGINT) AS e, CAST(round_even(0.0078125 * n, 0) AS BIGINT) AS i, CAST(round_even((1 - (coverage * 0.5 + 0.015625 + 0.0078125)) * n, 0) AS BIGINT) AS r FROM q")
def _(spark, d):
    x = par.initial_counts(_c("n"), _c("coverage") * 0.5, F.lit(0.015625), F.lit(0.0078125))
    return _params(spark, d).select("id", *(x[k].alias(k) for k in "seir"))


@_q("e12_parameter_record", S_PAR + " SELECT id, round(sigma, 9) AS sigma, round(gamma, 9) AS gamma, round(mu, 9) AS mu, round(beta, 9) AS beta, round(CAST(1.06 AS DOUBLE) * mu * (r0 - 1) / sqrt(n), 12) AS epsilon, n, shape FROM q")
def _(spark, d):
    return _params(spark, d).select("id", *(_r(c, 9).alias(c) for c in ("sigma", "gamma", "mu", "beta")), _r(par.import_rate(_c("mu"), _c("r0"), _c("n")), 12).alias("epsilon"), "n", "shape")


# Count series ------------------------------------------------------------------------------------------------------

@_q("t1_pooled_mean", S_SERIES + " SELECT avg(incidence) AS mean FROM series")
def _(spark, d):
    return se.pooled_mean(_series(spark, d))


@_q("t2_mean_of_means", S_SERIES + " , m AS (SELECT sim, avg(noise) AS a, avg(incidence) AS b FROM series GROUP BY sim) SELECT round(avg(a), 9) AS dynamic_part, round(avg(b), 9) AS static_part, round(avg(a) + avg(b), 9) AS total FROM m")
def _(spark, d):
    out = se.mean_of_means(_series(spark, d), {"dynamic_part": "noise", "static_part": "incidence"}, SIM)
    return out.select(*(_r(c, 9).alias(c) for c in out.columns))


@_q("t3_noise_target", S_SERIES + " SELECT l.noise_level, round(l.noise_level * m.mean, 9) AS target FROM (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS noise_level FROM lineitem) l, (SELECT avg(incidence) AS mean FROM series) m")
def _(spark, d):
    levels = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("double").alias("noise_level")).distinct()
    return levels.join(F.broadcast(se.pooled_mean(_series(spark, d)))).select("noise_level", _r(F.col("noise_level") * F.col("mean"), 9).alias("target"))


@_q("t4_static_background", "SELECT r_regionkey AS sim, true AS near FROM region")
def _(spark, d):
    series = _series(spark, d)
    drawn = se.static_background(series.drop("noise"), 20.0, 7, SIM)
    want = series.agg((20 * F.avg("incidence")).alias("want"))
    return drawn.groupBy("sim").agg(F.avg("noise").alias("m"), F.count("*").alias("days")).join(F.broadcast(want)).select("sim", (F.abs(F.col("m") - F.col("want")) < 5 * F.sqrt(F.col("want") / F.col("days"))).alias("near"))


@_q("t5_combine_series", S_SERIES + " SELECT sim, day, incidence, noise, incidence + noise AS total FROM series")
def _(spark, d):
    series = _series(spark, d)
    return se.combine(series.select("sim", "day", "incidence"), series.select("sim", "day", "noise"), SIM)


@_q("t5_unmatched_rows", S_SERIES + " SELECT count(*) FILTER (WHERE day > 2400) AS n_unmatched FROM series")
def _(spark, d):
    series = _series(spark, d)
    return se.unmatched(series.select("sim", "day", "incidence"), series.where("day <= 2400").select("sim", "day", "noise"), SIM)


S_TEST = S_SERIES + """,
tests(sensitivity, specificity, test_lag) AS (VALUES (CAST(0.85 AS DOUBLE), CAST(0.85 AS DOUBLE), 0), (0.9, 0.9, 0), (1.0, 1.0, 0), (1.0, 1.0, 14)),
percents(percent_tested) AS (VALUES (CAST(0.4 AS DOUBLE)), (1.0)),
tested AS (
  SELECT sim, day, incidence, noise, percent_tested, sensitivity, specificity, test_lag, CAST(round_even(incidence * percent_tested, 0) AS BIGINT) AS tested_pos,
    CAST(round_even(noise * percent_tested, 0) AS BIGINT) AS tested_noise FROM series, percents, tests),
raw AS (SELECT *, CAST(round_even(tested_pos * sensitivity, 0) AS BIGINT) AS tp, CAST(round_even(tested_noise * (1 - specificity), 0) AS BIGINT) AS fp FROM tested),
late AS (
  SELECT *, CASE WHEN test_lag = 14 THEN lag(tp, 14, 0) OVER w ELSE tp END AS true_pos, CASE WHEN test_lag = 14 THEN lag(fp, 14, 0) OVER w ELSE fp END AS false_pos
  FROM raw WINDOW w AS (PARTITION BY sim, percent_tested, sensitivity, specificity, test_lag ORDER BY day))"""


def _tested(spark: SparkSession, d: str) -> DataFrame:
    return te.expected_positives(_series(spark, d), RATES, TESTS, SIM)


@_q("t6_tested_draws", "SELECT r_regionkey AS sim, true AS near FROM region")
def _(spark, d):
    drawn = te.drawn_positives(_series(spark, d), [0.4], [te.TestSpec(1.0, 1.0, 0)], SIM)
    sums = drawn.groupBy("sim").agg(F.sum("incidence").alias("n"), F.sum("tested_pos").alias("x"))
    return sums.select("sim", (F.abs(F.col("x") - 0.4 * F.col("n")) <= 6 * F.sqrt(0.24 * F.col("n")) + 1).alias("near"))


@_q("t6b_expected_tested", S_TEST + " SELECT sim, day, percent_tested, tested_pos, tested_noise FROM late WHERE sensitivity = 0.9")
def _(spark, d):
    return _tested(spark, d).where("sensitivity = 0.9").select("sim", "day", "percent_tested", "tested_pos", "tested_noise")


@_q("t7_true_positives", S_TEST + " SELECT sim, day, percent_tested, sensitivity, specificity, test_lag, true_pos FROM late")
def _(spark, d):
    return _tested(spark, d).select("sim", "day", *te.TEST_KEYS, "true_pos")


@_q("t8_false_positives", S_TEST + " SELECT sim, day, percent_tested, sensitivity, specificity, test_lag, false_pos FROM late")
def _(spark, d):
    return _tested(spark, d).select("sim", "day", *te.TEST_KEYS, "false_pos")


@_q("t9_test_positives", S_TEST + " SELECT sim, day, percent_tested, sensitivity, specificity, test_lag, true_pos + false_pos AS test_pos FROM late")
def _(spark, d):
    return _tested(spark, d).select("sim", "day", *te.TEST_KEYS, "test_pos")


@_q("t10_independent_streams", S_SERIES + " SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ FROM series")
def _(spark, d):
    series, test = _series(spark, d), [te.TestSpec(0.9, 0.9, 0)]
    one = te.drawn_positives(series, [0.5], test, SIM).select("sim", "day", F.col("true_pos").alias("a"))
    two = te.drawn_positives(series.withColumn("noise", F.col("noise") * 3 + 1), [0.5], test, SIM).select("sim", "day", F.col("true_pos").alias("b"))
    return one.join(two, ["sim", "day"]).agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


@_q("t11_trailing_mean", S_POS + " SELECT sim, day, test_pos_ma FROM ma")
def _(spark, d):
    return _positives(_series(spark, d)).select("sim", "day", "test_pos_ma")


@_q("t12_rounded_mean", S_POS + " SELECT sim, day, CAST(round_even(test_pos_ma, 0) AS BIGINT) AS rounded FROM ma")
def _(spark, d):
    return _positives(_series(spark, d)).select("sim", "day", F.bround("test_pos_ma").cast("long").alias("rounded"))


@_q("t13_shift", S_SERIES + " SELECT sim, day, lag(incidence, 3, 0) OVER w AS later, lead(incidence, 2, 0) OVER w AS earlier, incidence AS same FROM series WINDOW w AS (PARTITION BY sim ORDER BY day)")
def _(spark, d):
    return _series(spark, d).select("sim", "day", *(se.shifted(F.col("incidence"), k, SIM).alias(n) for k, n in ((3, "later"), (-2, "earlier"), (0, "same"))))


@_q("t14_scale", S_SERIES + " SELECT sim, day, noise * CAST(1.5 AS DOUBLE) AS scaled FROM series")
def _(spark, d):
    return _series(spark, d).select("sim", "day", (F.col("noise") * 1.5).alias("scaled"))


@_q("t15_alert_inputs", S_POS + " SELECT sim, day, CAST(test_pos AS DOUBLE) AS daily, test_pos_ma AS mean, greatest(test_pos, test_pos_ma) AS dual FROM ma")
def _(spark, d):
    return _positives(_series(spark, d)).select("sim", "day", *(se.compared(F.lit(m)).alias(n) for m, n in zip(METHODS, ("daily", "mean", "dual"))))


@_q("t16_alert_flag", S_POS + " SELECT sim, day, test_pos >= 3 AS daily, test_pos_ma >= 3 AS mean, test_pos >= 3 OR test_pos_ma >= 3 AS dual FROM ma")
def _(spark, d):
    return _positives(_series(spark, d)).select("sim", "day", *(rn.alert_flag(se.compared(F.lit(m)), F.lit(3.0)).alias(n) for m, n in zip(METHODS, ("daily", "mean", "dual"))))


@_q("t17_runs", S_ALERT + " SELECT * FROM alerts")
def _(spark, d):
    return _world(spark, d)[2]


@_q("t18_outbreak_classes", S_OUT + " SELECT sim, lo, hi, duration, size, CAST(duration >= 3 AND size >= 4 * thr AS INTEGER) AS status FROM oruns, spec")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return rn.outbreak_runs(series, _spec(series), SIM).drop("run_idx")


@_q("t19_outbreaks", S_OUT + " SELECT * FROM outbreaks")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return rn.outbreaks(series, _spec(series), SIM)


@_q("t19_outbreak_specs", S_OUT + """,
specs AS (SELECT 1 AS outbreak_spec, thr AS t, 3 AS least_days, 4 * thr AS least_size FROM spec UNION ALL SELECT 2, thr + 1, 2, thr + 1 FROM spec UNION ALL SELECT 3, 1, 5, 10 FROM spec),
sflag AS (SELECT sim, outbreak_spec, day, incidence, day - row_number() OVER (PARTITION BY sim, outbreak_spec ORDER BY day) AS island FROM series JOIN specs ON incidence >= t),
sruns AS (SELECT sim, outbreak_spec, min(day) AS lo, max(day) AS hi, count(*) AS duration, CAST(sum(incidence) AS BIGINT) AS size FROM sflag GROUP BY sim, outbreak_spec, island)
SELECT sim, outbreak_spec, CAST(row_number() OVER (PARTITION BY sim, outbreak_spec ORDER BY lo) AS INTEGER) AS outbreak_idx, lo, hi, duration, size FROM sruns JOIN specs USING (outbreak_spec) WHERE duration >= least_days AND size >= least_size""")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    one = _spec(series)
    return rn.outbreaks(series, [one, rn.OutbreakSpec(one.threshold + 1, 2, one.threshold + 1), rn.OutbreakSpec(1, 5, 10)], SIM)


@_q("t20_outbreak_status", S_OUT + " SELECT s.sim, s.day, CAST(o.sim IS NOT NULL AS INTEGER) AS status FROM series s LEFT JOIN outbreaks o ON o.sim = s.sim AND s.day BETWEEN o.lo AND o.hi")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return rn.outbreak_status(series, _spec(series), SIM)


@_q("t21_series_without_outbreak", S_OUT + " SELECT r_regionkey AS sim FROM region WHERE r_regionkey NOT IN (SELECT sim FROM outbreaks WHERE size >= 30 * (SELECT thr FROM spec))")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    spec = _spec(series)
    return rn.without_outbreak(series.select("sim").distinct(), rn.outbreaks(series, spec, SIM).where(F.col("size") >= 30 * spec.threshold), SIM)


@_q("t22_time_window", S_OUT + " SELECT sim, outbreak_idx, lo, hi FROM outbreaks WHERE lo >= 365 AND hi <= 1460")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return se.in_years(rn.outbreaks(series, _spec(series), SIM), 1, 4).select("sim", "outbreak_idx", "lo", "hi")


# Matching and metrics ----------------------------------------------------------------------------------------------

@_q("m1_overlaps_all", S_ALERT + " SELECT sim, outbreak_idx, alert_idx FROM met")
def _(spark, d):
    return _world(spark, d, match=mt.MULTIPLE)[4].select("sim", "outbreak_idx", "alert_idx")


@_q("m2_overlaps_post_start", S_ALERT + " SELECT sim, outbreak_idx, alert_idx FROM met JOIN outbreaks USING (sim, outbreak_idx) WHERE alert_lo BETWEEN lo AND hi")
def _(spark, d):
    return _world(spark, d, mt.POST_START, mt.MULTIPLE)[4].select("sim", "outbreak_idx", "alert_idx")


@_q("m3_single_outbreak", S_ALERT + " SELECT * FROM pairs")
def _(spark, d):
    return _world(spark, d)[4]


@_q("m4_multiple_outbreaks", S_ALERT + " SELECT sim, outbreak_idx, alert_idx, alert_lo, outbreak_lo FROM met")
def _(spark, d):
    return _world(spark, d, match=mt.MULTIPLE)[4]


@_q("m5_matched_lists", S_ALERT + " SELECT sim, outbreak_idx, count(*) AS n, array_to_string(list_sort(list(alert_idx)), ',') AS alerts FROM pairs GROUP BY sim, outbreak_idx")
def _(spark, d):
    return mt.matched_lists(_world(spark, d)[4], SIM).select("sim", "outbreak_idx", "n", F.array_join("alerts", ",").alias("alerts"))


@_q("m6_invariants", S_ALERT + """,
damaged AS (
  SELECT sim, outbreak_idx, alert_idx, alert_idx % 7 = 1 AS lost_alert, outbreak_idx % 5 = 1 AS lost_outbreak FROM pairs
  UNION ALL SELECT sim, outbreak_idx + 1, alert_idx, alert_idx % 7 = 1, outbreak_idx % 5 = 0 FROM pairs WHERE alert_idx % 3 = 0 AND outbreak_idx + 1 <= (SELECT count(*) FROM outbreaks o WHERE o.sim = pairs.sim))
SELECT 'none' AS given, CAST(NULL AS VARCHAR) AS problem, count(*) AS n FROM (SELECT sim, alert_idx FROM pairs GROUP BY sim, alert_idx HAVING count(*) > 1)
UNION ALL SELECT 'damaged', 'alert', count(*) FROM damaged WHERE lost_alert UNION ALL SELECT 'damaged', 'outbreak', count(*) FROM damaged WHERE lost_outbreak
UNION ALL SELECT 'damaged', 'repeated', count(*) FROM (SELECT sim, alert_idx FROM damaged GROUP BY sim, alert_idx HAVING count(*) > 1)""")
def _(spark, d):
    """Sound pairs have no violation; with some alerts and outbreaks taken away and alerts paired twice each kind is found."""
    _, _, alerts, outbreaks, pairs, sims = _world(spark, d)
    found = mt.violations(pairs, alerts, outbreaks, SIM).agg(F.lit("none").alias("given"), F.lit(None).cast("string").alias("problem"), F.count("*").alias("n"))
    again = pairs.where("alert_idx % 3 = 0").withColumn("outbreak_idx", (F.col("outbreak_idx") + 1).cast("int")).join(outbreaks.select("sim", "outbreak_idx"), ["sim", "outbreak_idx"], "left_semi")
    damaged = pairs.select("sim", "outbreak_idx", "alert_idx").unionByName(again.select("sim", "outbreak_idx", "alert_idx"))
    bad = mt.violations(damaged, alerts.where("alert_idx % 7 <> 1"), outbreaks.where("outbreak_idx % 5 <> 1"), SIM).groupBy("problem").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("alert",), ("outbreak",), ("repeated",)], "problem string")
    return found.union(kinds.join(bad, "problem", "left").select(F.lit("damaged"), "problem", F.coalesce("n", F.lit(0)).cast("long")))


@_q("m7_matched_alerts", S_ALERT + " SELECT DISTINCT sim, alert_idx FROM met")
def _(spark, d):
    return mt.matched_alerts(_world(spark, d, match=mt.MULTIPLE)[4], SIM)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    _, _, alerts, outbreaks, pairs, sims = _world(spark, d)
    return me.series_counts(sims, alerts, outbreaks, pairs, SIM)


@_q("m8_counts", S_ALERT + " SELECT sim, n_alerts, n_outbreaks FROM tallies")
def _(spark, d):
    return _counts(spark, d).select("sim", "n_alerts", "n_outbreaks")


@_q("m9_sensitivity", S_ALERT + " SELECT sim, detected FROM rates")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", "detected")


@_q("m10_ppv", S_ALERT + " SELECT sim, ppv FROM rates")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", "ppv")


@_q("m11_accuracy_dispatch", S_ALERT + " SELECT sim, round(CASE WHEN sim % 2 = 0 THEN f1 ELSE balanced END, 9) AS accuracy FROM acc")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", _r(me.accuracy(F.when(F.col("sim") % 2 == 0, "F1").otherwise("BalancedAccuracy"), F.col("ppv"), F.col("detected")), 9).alias("accuracy"))


@_q("m12_balanced", S_ALERT + " SELECT sim, round(balanced, 9) AS x FROM acc")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", _r(me.balanced(F.col("ppv"), F.col("detected")), 9).alias("x"))


@_q("m13_f_beta", S_ALERT + " SELECT sim, round(f1, 9) AS f1, round(coalesce(5 * ppv * detected / nullif(4 * ppv + detected, 0), 0), 9) AS f2 FROM acc")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", *(_r(me.f_beta(F.col("ppv"), F.col("detected"), b), 9).alias(f"f{b}") for b in (1, 2)))


@_q("m14_series_accuracy", S_ALERT + " SELECT sim, n_alerts, n_outbreaks, round(balanced, 9) AS accuracy FROM acc")
def _(spark, d):
    return me.rates(_counts(spark, d)).select("sim", "n_alerts", "n_outbreaks", _r("accuracy", 9).alias("accuracy"))


@_q("m15_mean_accuracy", S_ALERT + " SELECT round(avg(balanced), 9) AS accuracy FROM acc")
def _(spark, d):
    return me.rates(_counts(spark, d)).agg(_r(F.avg("accuracy"), 9).alias("accuracy"))


@_q("m16_delays", S_ALERT + " SELECT sim, outbreak_idx, alert_lo - outbreak_lo AS delay FROM firsts")
def _(spark, d):
    return me.delays(mt.first_alerts(_world(spark, d)[4], SIM), SIM)


@_q("m17_unavoidable_cases", S_ALERT + " SELECT * FROM avoid")
def _(spark, d):
    series, _, _, outbreaks, pairs, _ = _world(spark, d)
    return me.unavoidable(series, outbreaks, mt.first_alerts(pairs, SIM), SIM)


@_q("m18_durations", S_ALERT + " SELECT sim, 'alert' AS kind, duration FROM alerts UNION ALL SELECT sim, 'outbreak', duration FROM outbreaks")
def _(spark, d):
    _, _, alerts, outbreaks, _, _ = _world(spark, d)
    return alerts.select("sim", F.lit("alert").alias("kind"), "duration").union(outbreaks.select("sim", F.lit("outbreak"), "duration"))


S_SHARE = """ SELECT s.sim, coalesce((SELECT sum(duration) FROM alerts a WHERE a.sim = s.sim), 0) / (SELECT CAST(n AS DOUBLE) FROM ends) AS share_in_alert,
coalesce((SELECT sum(duration) FROM outbreaks o WHERE o.sim = s.sim), 0) / (SELECT CAST(n AS DOUBLE) FROM ends) AS share_in_outbreak FROM sims s"""


@_q("m19_time_shares", S_ALERT + S_SHARE)
def _(spark, d):
    _, _, alerts, outbreaks, _, sims = _world(spark, d)
    return me.share_of_time(sims, alerts, SIM, "share_in_alert").join(me.share_of_time(sims, outbreaks, SIM, "share_in_outbreak"), "sim")


@_q("m20_metric_record", S_ALERT + """ SELECT a.sim, n_alerts, n_outbreaks, round(balanced, 9) AS accuracy, ppv, detected,
array_to_string((SELECT list(alert_lo - outbreak_lo ORDER BY outbreak_idx) FROM firsts f WHERE f.sim = a.sim), ',') AS delays,
array_to_string((SELECT list(cases ORDER BY outbreak_idx) FROM avoid v WHERE v.sim = a.sim), ',') AS unavoidable_cases,
array_to_string((SELECT list(duration ORDER BY alert_idx) FROM alerts x WHERE x.sim = a.sim), ',') AS alert_durations,
array_to_string((SELECT list(duration ORDER BY outbreak_idx) FROM outbreaks x WHERE x.sim = a.sim), ',') AS outbreak_durations,
coalesce((SELECT sum(duration) FROM alerts x WHERE x.sim = a.sim), 0) / (SELECT CAST(n AS DOUBLE) FROM ends) AS share_in_alert,
coalesce((SELECT sum(duration) FROM outbreaks x WHERE x.sim = a.sim), 0) / (SELECT CAST(n AS DOUBLE) FROM ends) AS share_in_outbreak FROM acc a""")
def _(spark, d):
    series, _, alerts, outbreaks, pairs, sims = _world(spark, d)
    out = me.record(sims, series, alerts, outbreaks, pairs, SIM, "BalancedAccuracy")
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return out.select("sim", "n_alerts", "n_outbreaks", _r("accuracy", 9).alias("accuracy"), "ppv", "detected", text("delays"), text("unavoidable_cases"), text("alert_durations"), text("outbreak_durations"), "share_in_alert", "share_in_outbreak")


# Threshold selection -----------------------------------------------------------------------------------------------

KEYS = ["percent_tested", "sensitivity", "specificity", "test_lag", "sim"]
SCENARIO = KEYS[:-1]


def _sweep_input(spark: SparkSession, d: str, levels: list[float] | None = None):
    """Series, outbreaks, test positives with outbreak_idx, and a grid of thresholds up to twice the mean.

    levels: every background level of a batch, with noise_level as a further key.
    """
    series = _kept(spark, _series(spark, d))
    means = series.agg(F.avg("incidence"), F.avg(F.col("incidence") + F.col("noise"))).first()
    outbreaks = rn.outbreaks(series, _spec_of(means[0]), SIM)
    marked, keys = rn.marked(series, outbreaks, SIM), SIM
    if levels:
        rows = marked.select("sim", "day", "incidence", "noise", "outbreak_idx", F.explode(F.lit(levels)).alias("noise_level"))
        marked, keys = rows.withColumn("noise", F.bround(F.col("noise") * F.col("noise_level")).cast("long")), [*SIM, "noise_level"]
    positives = se.with_alert_inputs(te.expected_positives(marked, RATES, TESTS, keys), [*KEYS, *keys[1:]])
    return series, outbreaks, positives, sw.equal_grid(0.0, float(2 * math.ceil(means[1])), 10)[1:]


def _sweep_sql(tests: str, methods: str, levels: str = "", metrics: str = "'BalancedAccuracy'") -> str:
    """Scores by metric and best thresholds; tests: key columns of a test positive, methods: those of a compared value."""
    series = "series" if not levels else f"(SELECT sim, day, incidence, CAST(round_even(noise * noise_level, 0) AS BIGINT) AS noise, noise_level FROM series, (SELECT unnest([{levels}]) AS noise_level)) series"
    tested = S_TEST[len(S_SERIES) :].replace("percent_tested, sensitivity, specificity, test_lag,", f"{tests},").replace("percent_tested, sensitivity, specificity, test_lag ", f"{tests} ").replace("FROM series, percents", f"FROM {series}, percents")
    compared = "CASE alert_method WHEN 'DailyThreshold' THEN CAST(daily AS DOUBLE) WHEN 'MovingAverage' THEN mean ELSE greatest(daily, mean) END"
    several = methods != tests
    return S_SERIES + tested + S_OUT[len(S_SERIES) :] + f""",
smoothed AS (SELECT {tests}, sim, day, true_pos + false_pos AS daily, avg(true_pos + false_pos) OVER (PARTITION BY sim, {tests} ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean FROM late),
ready AS (SELECT {methods}, sim, day, {compared if several else "mean"} AS value FROM smoothed{", (SELECT unnest(['DailyThreshold', 'MovingAverage', 'DailyThresholdMovingAverage']) AS alert_method)" if several else ""}),
upper_bound AS (SELECT 2 * ceil(avg(incidence + noise)) AS u FROM series),
cands AS (SELECT CAST(0 AS DOUBLE) + k * (u - CAST(0 AS DOUBLE)) / 10 AS "T" FROM upper_bound, (SELECT unnest(range(1, 11)) AS k)),
reached AS (SELECT {methods}, sim, "T", day, day - row_number() OVER (PARTITION BY {methods}, sim, "T" ORDER BY day) AS island FROM ready JOIN cands ON value >= "T"),
aruns AS (SELECT {methods}, sim, "T", island, min(day) AS lo, max(day) AS hi FROM reached GROUP BY ALL),
met AS (
  SELECT a.*, outbreak_idx, row_number() OVER (PARTITION BY {methods}, a.sim, "T", a.lo ORDER BY outbreak_idx) AS n
  FROM aruns a JOIN outbreaks o ON a.sim = o.sim AND ((a.lo >= o.lo AND a.lo <= o.hi) OR (a.lo <= o.lo AND a.hi > o.lo))),
every AS (SELECT DISTINCT {methods}, sim, "T" FROM ready, cands),
na AS (SELECT {methods}, sim, "T", count(*) AS n_alerts FROM aruns GROUP BY ALL),
nm AS (SELECT {methods}, sim, "T", count(*) AS hits, count(DISTINCT outbreak_idx) AS found FROM met WHERE n = 1 GROUP BY ALL),
no AS (SELECT sim, count(*) AS n_outbreaks FROM outbreaks GROUP BY sim),
ratios AS (
  SELECT e.*, coalesce(hits, 0) / nullif(coalesce(n_alerts, 0), 0) AS ppv, coalesce(found, 0) / nullif(coalesce(n_outbreaks, 0), 0) AS sens
  FROM every e LEFT JOIN na USING ({methods}, sim, "T") LEFT JOIN nm USING ({methods}, sim, "T") LEFT JOIN no USING (sim)),
scored AS (
  SELECT {methods}, accuracy_metric, "T",
    round(avg(CASE accuracy_metric WHEN 'F1' THEN coalesce(2 * ppv * sens / nullif(ppv + sens, 0), 0)
      ELSE (coalesce(ppv, 0) + coalesce(sens, 0)) / nullif((ppv IS NOT NULL)::INT + (sens IS NOT NULL)::INT, 0) END), 9) AS mean_accuracy
  FROM ratios, (SELECT unnest([{metrics}]) AS accuracy_metric) GROUP BY ALL),
losses AS (SELECT *, round(1 - mean_accuracy, 9) AS loss FROM scored),
best AS (
  SELECT * EXCLUDE (k, mean_accuracy) FROM (
    SELECT *, row_number() OVER (PARTITION BY {methods}, accuracy_metric ORDER BY loss, "T") AS k FROM losses WHERE loss IS NOT NULL) WHERE k = 1)"""


TEST = "percent_tested, sensitivity, specificity, test_lag"
S_SWEEP = _sweep_sql(TEST, TEST)
S_BATCH = _sweep_sql(f"noise_level, {TEST}", f"alert_method, noise_level, {TEST}", "CAST(0.5 AS DOUBLE), 1.0, 2.0", "'BalancedAccuracy', 'F1'")
LEVELS = [0.5, 1.0, 2.0]


def _ready(positives: DataFrame) -> DataFrame:
    return sw.prepared(positives, "MovingAverage").select(*KEYS, "day", "value", "outbreak_idx")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    _, _, positives, candidates = _sweep_input(spark, d)
    return sw.scores(_ready(positives), candidates, KEYS, SIM, "BalancedAccuracy")


@_q("o1_candidate_scores", S_SWEEP + " SELECT * EXCLUDE (accuracy_metric) FROM losses")
def _(spark, d):
    return _scored(spark, d)


@_q("o2_best_threshold", S_SWEEP + " SELECT * EXCLUDE (accuracy_metric) FROM best")
def _(spark, d):
    return sw.best(_scored(spark, d), SCENARIO)


@_q("o3_breakpoint_sweep", S_ALERT + """,
points AS (SELECT DISTINCT CAST(test_pos AS DOUBLE) AS "T" FROM ma WHERE test_pos >= 1 UNION SELECT greatest(CAST(1 AS DOUBLE), max(test_pos)) FROM ma),
xflag AS (SELECT sim, "T", day, day - row_number() OVER (PARTITION BY sim, "T" ORDER BY day) AS island FROM ma JOIN points ON test_pos >= "T"),
xruns AS (SELECT sim, "T", island, min(day) AS lo, max(day) AS hi FROM xflag GROUP BY ALL),
xmet AS (SELECT a.*, outbreak_idx, row_number() OVER (PARTITION BY a.sim, "T", a.lo ORDER BY outbreak_idx) AS n FROM xruns a JOIN outbreaks o ON a.sim = o.sim AND ((a.lo >= o.lo AND a.lo <= o.hi) OR (a.lo <= o.lo AND a.hi > o.lo))),
xr AS (
  SELECT s.sim, p."T", (SELECT count(*) FROM xmet m WHERE m.sim = s.sim AND m."T" = p."T" AND n = 1) / nullif((SELECT count(*) FROM xruns r WHERE r.sim = s.sim AND r."T" = p."T"), 0) AS ppv,
    (SELECT count(DISTINCT outbreak_idx) FROM xmet m WHERE m.sim = s.sim AND m."T" = p."T" AND n = 1) / nullif((SELECT count(*) FROM outbreaks o WHERE o.sim = s.sim), 0) AS sens FROM sims s, points p),
xs AS (SELECT "T", round(1 - round(avg((coalesce(ppv, 0) + coalesce(sens, 0)) / nullif((ppv IS NOT NULL)::INT + (sens IS NOT NULL)::INT, 0)), 9), 9) AS loss FROM xr GROUP BY "T")
SELECT CAST(0.9 AS DOUBLE) AS sensitivity, "T", loss FROM xs WHERE loss IS NOT NULL ORDER BY loss, "T" LIMIT 1""")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    marked = rn.marked(series, rn.outbreaks(series, _spec(series), SIM), SIM)
    ready = sw.prepared(se.with_alert_inputs(te.expected_positives(marked, [1.0], ONE_TEST, SIM), KEYS), "DailyThreshold").select(*KEYS, "day", "value", "outbreak_idx")
    points = _kept(spark, sw.breakpoints(ready, 1.0, SCENARIO))
    return sw.best(sw.scores(ready, points, KEYS, SIM, "BalancedAccuracy"), SCENARIO).select("sensitivity", "T", "loss")


@_q("o3_averaged_breakpoints", _sweep_sql(TEST, TEST).replace("""cands AS (SELECT CAST(0 AS DOUBLE) + k * (u - CAST(0 AS DOUBLE)) / 10 AS "T" FROM upper_bound, (SELECT unnest(range(1, 11)) AS k))""",
f"""cands AS (SELECT DISTINCT {TEST}, value AS "T" FROM ready WHERE value >= 0 UNION SELECT {TEST}, greatest(max(value), CAST(0 AS DOUBLE)) FROM ready GROUP BY {TEST})""").replace('FROM ready JOIN cands ON value >= "T"', f'FROM ready JOIN cands USING ({TEST}) WHERE value >= "T"').replace("FROM ready, cands)", f"FROM ready JOIN cands USING ({TEST}))")
+ " SELECT * EXCLUDE (accuracy_metric) FROM best")
def _(spark, d):
    """Every value that a moving average takes is a candidate of its scenario."""
    _, _, positives, _ = _sweep_input(spark, d)
    ready = _kept(spark, _ready(positives))
    return sw.best(sw.scores(ready, _kept(spark, sw.breakpoints(ready, 0.0, SCENARIO)), KEYS, SIM, "BalancedAccuracy"), SCENARIO)


@_q("o4_optimal_result", S_SWEEP + """ SELECT percent_tested, sensitivity, specificity, test_lag, sim, "T", loss, coalesce(n_alerts, 0) AS n_alerts, coalesce(n_outbreaks, 0) AS n_outbreaks, ppv, sens AS detected
FROM best JOIN ratios USING (percent_tested, sensitivity, specificity, test_lag, "T") LEFT JOIN na USING (percent_tested, sensitivity, specificity, test_lag, sim, "T") LEFT JOIN no USING (sim)""")
def _(spark, d):
    series, outbreaks, positives, candidates = _sweep_input(spark, d)
    ready = _kept(spark, _ready(positives))
    chosen = _kept(spark, sw.best(sw.scores(ready, candidates, KEYS, SIM, "BalancedAccuracy"), SCENARIO))
    out = sw.result_at(ready, chosen, series, outbreaks, KEYS, SIM, "BalancedAccuracy")
    return out.select(*KEYS, "T", "loss", "n_alerts", "n_outbreaks", "ppv", "detected")


@_q("o5_scenario_batch", S_BATCH + " SELECT * FROM best")
def _(spark, d):
    _, _, positives, candidates = _sweep_input(spark, d, LEVELS)
    return sw.sweep_all(positives, candidates, METHODS, ["BalancedAccuracy", "F1"], [*KEYS[:-1], "noise_level", "sim"], SIM)


S_RECORD = S_SWEEP + f""",
chosen AS (SELECT * EXCLUDE (accuracy_metric) FROM best),
told AS (SELECT a.*, hi - lo + 1 AS duration FROM aruns a JOIN chosen USING ({TEST}, "T")),
heard AS (SELECT {TEST}, sim, outbreak_idx, min(lo) AS alert_lo FROM met m JOIN chosen USING ({TEST}, "T") WHERE n = 1 GROUP BY ALL),
whole AS (SELECT sim, count(*) AS days FROM series GROUP BY sim),
each AS (SELECT {TEST}, "T", loss, sim, days FROM chosen, whole),
due AS (SELECT {TEST}, sim, outbreak_idx, o.lo, o.hi, o.duration, alert_lo FROM each e JOIN outbreaks o USING (sim) LEFT JOIN heard USING ({TEST}, sim, outbreak_idx)),
missed AS (
  SELECT {TEST}, due.sim, outbreak_idx, coalesce(sum(incidence), 0) AS cases
  FROM due LEFT JOIN series s ON s.sim = due.sim AND s.day >= lo AND s.day <= CASE WHEN alert_lo IS NULL THEN hi ELSE greatest(alert_lo, lo) - 1 END GROUP BY ALL),
by_outbreak AS (
  SELECT {TEST}, sim, list(alert_lo - lo ORDER BY outbreak_idx) FILTER (WHERE alert_lo IS NOT NULL) AS delays, list(cases ORDER BY outbreak_idx) AS unavoidable_cases,
    list(duration ORDER BY outbreak_idx) AS outbreak_durations, sum(duration) AS outbreak_days FROM due JOIN missed USING ({TEST}, sim, outbreak_idx) GROUP BY ALL),
by_alert AS (SELECT {TEST}, sim, list(duration ORDER BY lo) AS alert_durations, sum(duration) AS alert_days, count(*) AS n_alerts FROM told GROUP BY ALL),
record AS (
  SELECT e.*, coalesce(by_alert.n_alerts, 0) AS n_alerts, coalesce(n_outbreaks, 0) AS n_outbreaks, ppv, sens AS detected,
    round((coalesce(ppv, 0) + coalesce(sens, 0)) / nullif((ppv IS NOT NULL)::INT + (sens IS NOT NULL)::INT, 0), 9) AS accuracy,
    delays, unavoidable_cases, alert_durations, outbreak_durations,
    coalesce(alert_days, 0) / CAST(days AS DOUBLE) AS share_in_alert, coalesce(outbreak_days, 0) / CAST(days AS DOUBLE) AS share_in_outbreak
  FROM each e JOIN ratios r USING ({TEST}, "T", sim) LEFT JOIN no USING (sim) LEFT JOIN by_outbreak USING ({TEST}, sim) LEFT JOIN by_alert USING ({TEST}, sim))"""
RECORD_LISTS = ["delays", "unavoidable_cases", "alert_durations", "outbreak_durations"]


_RECORDS: dict[tuple[str, str], str] = {}


def _stored_records(spark: SparkSession, d: str) -> DataFrame:
    """The store that o6 filled for these tables in this session, else one that is filled now."""
    path = _RECORDS.get((spark.sparkContext.applicationId, d))
    found = st.load_snapshot(spark, f"{path}/results") if path else None
    return _recorded(spark, d) if found is None else found


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """The record of every series at its scenario's best threshold, as a run, and one that takes it up, leave it in the store."""
    series, outbreaks, positives, candidates = _sweep_input(spark, d)
    path, ready = _store(spark), _kept(spark, _ready(positives))
    _RECORDS[spark.sparkContext.applicationId, d] = path
    scenarios = _kept(spark, ready.select(*SCENARIO).distinct())

    def compute(todo: DataFrame) -> DataFrame:
        own = _kept(spark, sw.beside(ready, _kept(spark, todo.select(*SCENARIO)), SCENARIO))
        chosen = _kept(spark, sw.best(sw.scores(own, candidates, KEYS, SIM, "BalancedAccuracy"), SCENARIO))
        return sw.result_at(own, chosen, series, outbreaks, KEYS, SIM, "BalancedAccuracy").drop("series_id")

    run = lambda rows, ts: sw.resume(spark, rows, compute, f"{path}/results", f"{path}/checkpoints", ts, SCENARIO, batches=2)
    run(scenarios.where("sensitivity < 1"), "2024-01-01T00-00-00")
    return run(scenarios, "2024-01-02T00-00-00")


@_q("o6_resumable_run", S_RECORD + f""" SELECT {TEST}, sim, "T", loss, n_alerts, n_outbreaks, ppv, detected, accuracy, {", ".join(f"array_to_string({c}, ',') AS {c}" for c in RECORD_LISTS)}, share_in_alert, share_in_outbreak FROM record""")
def _(spark, d):
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    out = _recorded(spark, d)
    return out.select(*KEYS, "T", "loss", "n_alerts", "n_outbreaks", "ppv", "detected", _r("accuracy", 9).alias("accuracy"), *map(text, RECORD_LISTS), "share_in_alert", "share_in_outbreak")


# Reports -----------------------------------------------------------------------------------------------------------

@_q("r1_configured", S_REPORT + " SELECT * FROM report WHERE noise_type = 'static' AND sensitivity = 0.9 AND test_lag = 0")
def _(spark, d):
    return rp.configured(_report(spark, d), noise_type="static", sensitivity=0.9, test_lag=0)


@_q("r2_cells", S_REPORT + " SELECT *, CAST(dense_rank() OVER (ORDER BY noise_type DESC) AS INTEGER) AS i, CAST(dense_rank() OVER (ORDER BY noise_level) AS INTEGER) AS j FROM report")
def _(spark, d):
    return rp.cell_table(_report(spark, d))


@_q("r3_spec_order", S_REPORT + " SELECT DISTINCT sensitivity, specificity, test_lag, percent_tested, CAST(dense_rank() OVER (ORDER BY sensitivity, specificity, test_lag DESC, percent_tested) AS INTEGER) AS place FROM report")
def _(spark, d):
    from pyspark.sql import Window

    rows = _report(spark, d).select(*rp.SPEC, "percent_tested").distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*rp.spec_order("percent_tested"))))


@_q("r4_distinct_specs", S_REPORT + " SELECT DISTINCT sensitivity, specificity, test_lag, CAST(dense_rank() OVER (ORDER BY sensitivity, specificity, test_lag DESC) AS INTEGER) AS place FROM report")
def _(spark, d):
    return rp.distinct_specs(_report(spark, d))


@_q("r5_level_groups", S_REPORT + " SELECT noise_level, count(*) AS n FROM report GROUP BY noise_level")
def _(spark, d):
    return rp.level_groups(_report(spark, d))


@_q("r5_levels_differ", S_REPORT + " SELECT DISTINCT noise_level FROM report WHERE noise_level > 5")
def _(spark, d):
    report = _report(spark, d)
    return rp.levels_differ(report, report.where("noise_level <= 5"))


S_PCT = "round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90"


@_q("r6_summary", S_LINES + f" SELECT noise_type, noise_level, round(avg(value), 6) AS mean, {S_PCT} FROM lines GROUP BY ALL")
def _(spark, d):
    out = rp.summary(_lines(spark, d), ["noise_type", "noise_level"], "value", keep=partial(_kept, spark))
    return out.select("noise_type", "noise_level", *(_r(c).alias(c) for c in ("mean", "p10", "p90")))


#: Order lines whose lists a task makes.
TASK_LINES = 500_000


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """(noise_type, l_orderkey, nested): an order's values by level. Lists are made by sorting, so as many tasks share the lines as these need."""
    lines, order = _lines(spark, d), ["noise_type", "l_orderkey"]
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(lines.count() / TASK_LINES))
    by_level = lines.select(*order, "noise_level", "value").repartition(tasks, *order).groupBy(*order, "noise_level").agg(F.collect_list("value").alias("values"))
    return by_level.groupBy(*order).agg(F.collect_list("values").alias("nested"))


@_q("r7_nested_summary", S_LINES + f" SELECT noise_type, round(avg(value), 6) AS mean, {S_PCT} FROM lines GROUP BY ALL")
def _(spark, d):
    out = rp.summary(rp.flattened(_kept(spark, _nested(spark, d)), ["noise_type"], "nested"), ["noise_type"], "value", keep=partial(_kept, spark))
    return out.select("noise_type", *(_r(c).alias(c) for c in ("mean", "p10", "p90")))


@_q("r8_measure", S_REPORT + " SELECT noise_type, noise_level, sensitivity, specificity, test_lag, percent_tested, value FROM report")
def _(spark, d):
    return rp.measure(_report(spark, d).withColumnRenamed("value", "optimal_threshold"), "optimal_threshold", REPORT_KEYS)


@_q("r9_plot_series", S_LINES + f" SELECT noise_type, noise_level, sensitivity, specificity, test_lag, percent_tested, round(avg(value), 6) AS mean, {S_PCT} FROM lines GROUP BY ALL")
def _(spark, d):
    out = rp.summary(_lines(spark, d), REPORT_KEYS, "value", keep=partial(_kept, spark))
    return out.select(*REPORT_KEYS, *(_r(c).alias(c) for c in ("mean", "p10", "p90")))


@_q("r10_cell_value", S_LINES + " SELECT noise_type, noise_level, percent_tested, round(avg(value), 6) AS value FROM lines GROUP BY ALL")
def _(spark, d):
    keys = ["noise_type", "noise_level", "percent_tested"]
    rows = _lines(spark, d).groupBy(*keys, "l_orderkey").agg(F.collect_list("value").alias("values"))
    return rp.cell_values(rows, keys, "values").select(*keys, _r("value").alias("value"))


PERCENTS = [k / 10 for k in range(11)]
WIDE_IDS = ["noise_type", "noise_level", "sensitivity", "specificity", "test_lag"]
S_WIDE = S_REPORT + f""",
wide AS (
  SELECT noise_type, noise_level, sensitivity, specificity, test_lag, {", ".join(f'max(value) FILTER (WHERE percent_tested = {p}) AS "{p}"' for p in PERCENTS)},
    CASE WHEN sensitivity = 1 THEN 'Perfect Test' ELSE 'Imperfect Test (' || CAST(round_even(sensitivity * 100, 0) AS INTEGER) || '%)' END AS test_type
  FROM report GROUP BY ALL),
one AS (
  SELECT 'all_noise_structures' AS noise_type, CAST(NULL AS DOUBLE) AS noise_level, sensitivity, specificity, test_lag, {", ".join(f'"{p}"' for p in PERCENTS)}, test_type FROM (
    SELECT *, row_number() OVER (PARTITION BY test_type, test_lag ORDER BY noise_type, noise_level) AS k FROM wide WHERE test_type = 'Perfect Test') WHERE k = 1),
collapsed AS (SELECT * FROM wide WHERE test_type <> 'Perfect Test' UNION ALL SELECT * FROM one)"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return rp.wide(_report(spark, d), WIDE_IDS, PERCENTS)


@_q("r11_wide", S_WIDE + " SELECT * FROM wide")
def _(spark, d):
    return _wide(spark, d)


@_q("r11_repeated_cells", S_LINES + " SELECT noise_type, noise_level, sensitivity, specificity, test_lag, percent_tested, count(*) AS count FROM lines GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return rp.repeated_cells(_lines(spark, d), WIDE_IDS)


@_q("r12_collapsed", S_WIDE + " SELECT * FROM collapsed")
def _(spark, d):
    return rp.collapsed(_wide(spark, d))


@_q("r13_presented", S_WIDE + """ SELECT CASE noise_type WHEN 'static' THEN 'Static Noise' WHEN 'dynamic' THEN 'Dynamic Noise' ELSE 'All noise structures' END AS "Noise Type", noise_level, sensitivity, specificity,
test_lag AS "Test Lag", """ + ", ".join(f'"{p}" AS "{round(100 * p)}%"' for p in PERCENTS) + """, test_type AS "Test Type" FROM collapsed""")
def _(spark, d):
    return rp.presented(rp.collapsed(_wide(spark, d)))


@_q("r14_at_level", S_WIDE + " SELECT * FROM collapsed WHERE noise_level = 3 OR noise_type = 'all_noise_structures'")
def _(spark, d):
    return rp.at_level(rp.collapsed(_wide(spark, d)), 3.0)


@_q("r15_percent_columns", S_WIDE + ' SELECT noise_type, noise_level, test_type, test_lag, sensitivity, round((' + " + ".join(f'"{p}"' for p in PERCENTS) + ') / 11, 6) AS mean FROM wide')
def _(spark, d):
    table = _wide(spark, d)
    columns = rp.percent_columns(table)
    return table.select("noise_type", "noise_level", "test_type", "test_lag", "sensitivity", _r(sum((F.col(f"`{c}`") for c in columns[1:]), F.col(f"`{columns[0]}`")) / len(columns)).alias("mean"))


@_q("r16_baseline_difference", S_LINES + """,
long AS (SELECT sensitivity, specificity, test_lag, percent_tested, avg(value) AS value FROM lines GROUP BY ALL),
base AS (SELECT percent_tested, value AS base FROM long WHERE sensitivity = 1 AND test_lag = 0)
SELECT sensitivity, specificity, test_lag, round(avg(value - base), 6) AS mean_difference FROM long JOIN base USING (percent_tested) WHERE NOT (sensitivity = 1 AND test_lag = 0) GROUP BY ALL""")
def _(spark, d):
    long = _lines(spark, d).groupBy(*rp.SPEC, "percent_tested").agg(F.avg("value").alias("value"))
    out = rp.baseline_difference(long, rp.SPEC)
    return out.select(*rp.SPEC, _r("mean_difference").alias("mean_difference"))


@_q("r17_spread_of_means", S_REPORT + " SELECT sensitivity, specificity, test_lag, round_even(min(value), 2) AS lowest, round_even(max(value), 2) AS highest, round_even(avg(value), 2) AS mean, round_even(quantile_cont(value, 0.5), 2) AS median FROM report GROUP BY ALL")
def _(spark, d):
    return rp.spread_of_means(_lines(spark, d), ["noise_type", "noise_level", "percent_tested"], rp.SPEC, keep=partial(_kept, spark))


@_q("r18_characteristic_mean", S_LINES + " SELECT noise_type, noise_level, avg(value) AS mean FROM lines WHERE sensitivity = 1 AND test_lag = 14 GROUP BY ALL")
def _(spark, d):
    own = rp.configured(_lines(spark, d), sensitivity=1.0, specificity=1.0, test_lag=14)
    lists = own.groupBy("noise_type", "noise_level", "l_orderkey").agg(F.collect_list("value").alias("values"))
    return rp.cell_values(lists, ["noise_type", "noise_level"], "values", "mean")


@_q("r19_perfect_test_consistency", S_REPORT + """,
perfect AS (SELECT *, first_value(value) OVER (PARTITION BY percent_tested ORDER BY noise_type, noise_level) AS first FROM report WHERE sensitivity = 1 AND test_lag = 0)
SELECT noise_type, noise_level, percent_tested, value FROM perfect WHERE abs(value - first) > CAST(0.000001 AS DOUBLE)""")
def _(spark, d):
    rows = _report(spark, d).withColumn("ord", F.struct("noise_type", "noise_level"))
    return rp.inconsistent(rows, ["percent_tested"], "ord", ["value"]).select("noise_type", "noise_level", "percent_tested", "value")


@_q("r20_distribution", S_LINES + " SELECT sensitivity, test_lag, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM lines GROUP BY ALL")
def _(spark, d):
    out = rp.summary(_lines(spark, d), ["sensitivity", "test_lag"], "value", (0.25, 0.5, 0.75), keep=partial(_kept, spark))
    return out.select("sensitivity", "test_lag", *(_r(c).alias(c) for c in ("mean", "p25", "p50", "p75")))


@_q("r21_bootstrap_interval", S_REPORT + " SELECT round(avg(value), 6) AS mean, true AS inside, true AS near FROM report")
def _(spark, d):
    rows = _report(spark, d).withColumn("id", F.xxhash64(*REPORT_KEYS))
    out = rp.bootstrap(rows, "id", "value", 10_000)
    wide = rows.agg((F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("se"))
    near = (F.col("high") - F.col("low")).between(2.5 * F.col("se"), 5.5 * F.col("se"))
    return out.join(F.broadcast(wide)).select(_r("mean").alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("inside"), near.alias("near"))


S_PREV = "WITH g AS (SELECT l_shipdate, l_returnflag FROM lineitem), prev AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, count(*) FILTER (WHERE l_returnflag <> 'R') AS negatives FROM g GROUP BY 1)"


def _prevalence(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return lines.groupBy(F.year("l_shipdate").alias("year")).agg(F.count_if(F.col("l_returnflag") == "R").alias("positives"), F.count_if(F.col("l_returnflag") != "R").alias("negatives"))


@_q("r22_confusion_grid", S_PREV + """, axis AS (SELECT k * CAST(0.05 AS DOUBLE) AS v FROM (SELECT unnest(range(0, 21)) AS k)),
c AS (SELECT year, a.v AS sens, b.v AS spec, positives * a.v AS tp, negatives * b.v AS tn, positives, negatives FROM prev, axis a, axis b),
e AS (SELECT *, positives - tp AS fn, negatives - tn AS fp FROM c)
SELECT year, round(sens, 6) AS sens, round(spec, 6) AS spec, round(tp, 6) AS tp, round(tn, 6) AS tn, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tp / CASE WHEN tp + fp <> 0 THEN tp + fp END, 6) AS ppv,
round(tn / CASE WHEN tn + fn <> 0 THEN tn + fn END, 6) AS npv FROM e""")
def _(spark, d):
    return rp.confusion(_prevalence(spark, d)).select("year", *(_r(c).alias(c) for c in ("sens", "spec", "tp", "tn", "fp", "fn", "ppv", "npv")))


@_q("r23_difference_summary", S_LINES + """ SELECT sensitivity, specificity, test_lag, round(avg(value - noise_level), 6) AS mean, round(stddev_samp(value - noise_level), 6) AS sd, round(median(value - noise_level), 6) AS median,
min(value - noise_level) AS least, max(value - noise_level) AS most, round(quantile_cont(value - noise_level, 0.1), 6) AS q10, round(quantile_cont(value - noise_level, 0.25), 6) AS q25, round(quantile_cont(value - noise_level, 0.75), 6) AS q75, round(quantile_cont(value - noise_level, 0.9), 6) AS q90 FROM lines GROUP BY ALL""")
def _(spark, d):
    rows = _lines(spark, d).withColumn("difference", F.col("value") - F.col("noise_level"))
    out = rp.difference_summary(rows, rp.SPEC, "difference", keep=partial(_kept, spark))
    return out.select(*rp.SPEC, *(_r(c).alias(c) for c in ("mean", "sd", "median")), "least", "most", *(_r(c).alias(c) for c in ("q10", "q25", "q75", "q90")))


# Series in slices: what a series too long for one task needs ---------------------------------------------------------

DAYS = 97


@_q("t11_sliced_mean", S_POS + " SELECT sim, day, test_pos_ma FROM ma")
def _(spark, d):
    positives = te.expected_positives(_series(spark, d), [1.0], ONE_TEST, SIM)
    return sl.trailing_mean(positives, SIM, "test_pos", 7, "test_pos_ma", DAYS).select("sim", "day", "test_pos_ma")


@_q("t17_sliced_runs", S_OUT + " SELECT sim, CAST(row_number() OVER (PARTITION BY sim ORDER BY lo) AS INTEGER) AS run_idx, lo, hi, duration, size FROM oruns")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return sl.runs(series.where(F.col("incidence") >= _spec(series).threshold), SIM, "run_idx", {"size": F.col("incidence")}, DAYS)


@_q("t20_sliced_status", S_OUT + " SELECT s.sim, day, CAST(count(o.lo) AS INTEGER) AS status FROM series s LEFT JOIN outbreaks o ON s.sim = o.sim AND day BETWEEN o.lo AND o.hi GROUP BY s.sim, day")
def _(spark, d):
    series = _kept(spark, _series(spark, d))
    return sl.outbreak_status(series, _spec(series), SIM, DAYS)


@_q("m17_sliced_cases", S_ALERT + " SELECT * FROM avoid")
def _(spark, d):
    series, _, _, outbreaks, pairs, _ = _world(spark, d)
    return me.unavoidable(series, outbreaks, mt.first_alerts(pairs, SIM), SIM, slice_days=DAYS)


# Reports on the store: nested measures of its records ---------------------------------------------------------------

@_q("r6_stored_summary", S_RECORD + " SELECT sensitivity, specificity, test_lag, round(avg(accuracy), 6) AS mean, round(quantile_cont(accuracy, 0.1), 6) AS p10, round(quantile_cont(accuracy, 0.9), 6) AS p90 FROM record GROUP BY ALL")
def _(spark, d):
    out = rp.summary(_stored_records(spark, d), rp.SPEC, "accuracy", keep=partial(_kept, spark))
    return out.select(*rp.SPEC, *(_r(c).alias(c) for c in ("mean", "p10", "p90")))


@_q("r9_stored_delays", S_RECORD + f""", flat AS (SELECT {TEST}, unnest(delays) AS value FROM record)
SELECT {TEST}, round(avg(value), 6) AS mean, {S_PCT} FROM flat GROUP BY ALL""")
def _(spark, d):
    by_scenario = _stored_records(spark, d).select(*SCENARIO, F.array("delays").alias("nested"))
    out = rp.summary(rp.flattened(by_scenario, SCENARIO, "nested"), SCENARIO, "value", keep=partial(_kept, spark))
    return out.select(*SCENARIO, *(_r(c).alias(c) for c in ("mean", "p10", "p90")))


@_q("r10_stored_cells", S_RECORD + f""", flat AS (SELECT {TEST}, unnest(unavoidable_cases) AS value FROM record)
SELECT {TEST}, printf('%.2f', round_even(avg(value), 2)) AS value FROM flat GROUP BY ALL""")
def _(spark, d):
    out = rp.cell_values(_stored_records(spark, d), SCENARIO, "unavoidable_cases")
    return out.where("value is not null").select(*SCENARIO, rp.as_text("value").alias("value"))


@_q("r17_stored_spread", S_RECORD + f""", flat AS (SELECT {TEST}, unnest(alert_durations) AS value FROM record), means AS (SELECT {TEST}, avg(value) AS m FROM flat GROUP BY ALL)
SELECT sensitivity, specificity, test_lag, round_even(min(m), 2) AS lowest, round_even(max(m), 2) AS highest, round_even(avg(m), 2) AS mean, round_even(quantile_cont(m, 0.5), 2) AS median FROM means GROUP BY ALL""")
def _(spark, d):
    values = _stored_records(spark, d).select(*SCENARIO, F.explode("alert_durations").alias("value"))
    return rp.spread_of_means(values, ["percent_tested"], rp.SPEC, keep=partial(_kept, spark))


@_q("r19_stored_consistency", S_RECORD + """, perfect AS (
  SELECT percent_tested, sim, "T", accuracy, first_value("T") OVER w AS t, first_value(accuracy) OVER w AS a FROM record WHERE sensitivity = 1 AND test_lag = 0 WINDOW w AS (ORDER BY percent_tested, sim))
SELECT percent_tested, sim, "T", accuracy FROM perfect WHERE abs("T" - t) > CAST(0.000001 AS DOUBLE) OR abs(accuracy - a) > CAST(0.000001 AS DOUBLE)""")
def _(spark, d):
    rows = _stored_records(spark, d).withColumns({"ord": F.struct("percent_tested", "sim"), "accuracy": _r("accuracy", 9)})
    return rp.inconsistent(rows, ["test_lag"], "ord", ["T", "accuracy"]).select("percent_tested", "sim", "T", "accuracy")
