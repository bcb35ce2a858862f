"""Scenario keys, stores, sweeps and reports on small inputs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin import catalog
from tocsin.operators import matching as mt
from tocsin.operators import runs as rn
from tocsin.operators import series as se
from tocsin.operators import testing as te
from tocsin.plans import reports as rp
from tocsin.plans import scenarios as sc
from tocsin.plans import sweep as sw
from tocsin.sources import results as st
from tocsin.sources import series as src

SF = "/root/testdata/sf0.001"


def test_missing_scenarios_compare_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 7), (3, "b", 7)], "ord int, method string, window int")
    done = spark.createDataFrame([("a", None), ("a", None)], "method string, window int")
    keys = ["method", "window"]
    assert [r["ord"] for r in sc.missing(rows, done, keys).orderBy("ord").collect()] == [2, 3]
    assert sc.missing(rows, rows, keys).count() == 0
    assert sc.missing(rows, done.limit(0), keys).count() == 3
    assert sc.completed_keys(done, keys).count() == 1


def test_grid_order(spark):
    a, b = spark.createDataFrame([(2,), (1,)], "a int"), spark.createDataFrame([("x",), ("y",)], "b string")
    assert [tuple(r) for r in sc.grid([a, b]).orderBy("ord").collect()] == [(1, 1, "x"), (2, 2, "x"), (3, 1, "y"), (4, 2, "y")]


def test_percentiles(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    row = rp.summary(df, [], "v").first()
    assert (row["mean"], row["p10"], row["p90"]) == pytest.approx((5.5, 1.9, 9.1))
    row = rp.summary(spark.range(1, 101), [], "id", (0.25, 0.5, 0.75)).first()
    assert (row["p25"], row["p50"], row["p75"]) == pytest.approx((25.75, 50.5, 75.25))
    nested = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0, 5.0, 6.0], [7.0]],)], "x array<array<double>>")
    assert rp.summary(rp.flattened(nested, [], "x"), [], "value", (0.5,)).first()[:] == (4.0, 4.0)


def test_percentiles_of_groups_equal_sorting(spark):
    rng = random.Random(11)
    groups = {None: [rng.random() for _ in range(700)], "ties": [3.0] * 500 + [rng.choice([1.0, 3.0, 9.0]) for _ in range(333)], "one": [5.0], "two": [1.0, 2.0], "none": [None] * 4, "gaps": [None, -2.0, 8.5, None, 0.0]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    names = {"least": 0.0, "a": 0.1, "b": 0.5, "c": 0.933, "most": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for accuracy in (10, 10_000):
        found = {r["g"]: r for r in rp.percentiles(df, ["g"], "v", names, (F.count("*").alias("n"),), accuracy).collect()}
        assert found.keys() == groups.keys()
        for g, values in groups.items():
            own = sorted(v for v in values if v is not None)
            assert found[g]["n"] == len(values)
            for name, p in names.items():
                assert found[g][name] == (pytest.approx(np.quantile(own, p), rel=1e-12) if own else None), (g, name)
    assert rp.percentiles(df.limit(0), ["g"], "v", names).count() == 0


def test_percentiles_of_many_distinct_values(spark):
    """Ten million distinct values in one group; what is sorted is a small part of them."""
    n = 10_000_000
    df = spark.range(n, numPartitions=16).select(F.pmod(F.col("id") * 7_654_321, F.lit(n)).cast("double").alias("v"))
    row = rp.percentiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.987}).first()
    assert tuple(row) == pytest.approx(tuple(p * (n - 1) for p in (0.1, 0.5, 0.987)), rel=1e-12)
    lo, hi = df.agg(*(F.percentile_approx("v", F.lit(0.5 + s * 4 / rp.ACCURACY), F.lit(rp.ACCURACY)) for s in (-1, 1))).first()
    assert df.where(F.col("v").between(lo, hi)).count() < 16 * n / rp.ACCURACY


def test_percentiles_leave_rows_of_few_groups_where_they_are(spark, monkeypatch):
    """Two groups would meet in two tasks; with brackets kept they don't travel, and many groups are dealt in parts."""
    df = spark.range(3000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, "a").alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    keep, want = lambda x: catalog._kept(spark, x), {}
    for g, v in df.collect():
        want.setdefault(g, []).append(v)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most, few in ((2, True), (1, False)):
            monkeypatch.setattr(rp, "MOST_ROWS", most)
            out = rp.percentiles(df, ["g"], "v", {"low": 0.1, "high": 0.9}, accuracy=100, keep=keep)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan, "_salt" in plan) == (few, not few)
            found = {r["g"]: (r["low"], r["high"]) for r in out.collect()}
            assert found == {g: pytest.approx(tuple(np.quantile(v, (0.1, 0.9)))) for g, v in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nested_lists_are_made_by_as_many_tasks_as_lines_need(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(catalog, "TASK_LINES", 100)
    tasks = catalog._nested(spark, SF).select(F.spark_partition_id().alias("p"), F.size(F.flatten("nested")).alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == n and len(tasks) > 0.9 * n / 100 and max(r["n"] for r in tasks) < 300


def test_lines_stay_where_they_are_until_they_are_counted(spark, monkeypatch):
    """Suppliers go to the lines even where Spark wouldn't send them by itself; many are joined by a shuffle, with the same counts."""
    counts, before = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (src.MOST_SUPPLIERS, 0):
            monkeypatch.setattr(src, "MOST_SUPPLIERS", most)
            lines = src.shipped_lines(spark, SF)
            plan = lines._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(l_suppkey" in plan) == (most == 0)
            counts[most] = sorted(map(tuple, lines.groupBy("sim", "date").agg(F.count("*"), F.count_if("returned")).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(counts) == 2 and len({str(c) for c in counts.values()}) == 1


def test_spec_order(spark):
    rows = [(0.9, 0.95, 1), (0.8, 0.9, 2), (0.85, 0.92, 2), (0.95, 0.98, 1)]
    df = rp.distinct_specs(spark.createDataFrame(rows, "sensitivity double, specificity double, test_lag int"))
    assert [r["sensitivity"] for r in df.orderBy("place").collect()] == [0.8, 0.85, 0.9, 0.95]


def test_wide_refuses_repeated_cells(spark):
    long = spark.createDataFrame([("static", 1.0, 0.9, 0.9, 0, 0.5, 1.0)] * 2, "noise_type string, noise_level double, sensitivity double, specificity double, test_lag int, percent_tested double, value double")
    with pytest.raises(Exception, match="occurs twice"):
        rp.wide(long, ["noise_type", "noise_level", "sensitivity", "specificity", "test_lag"], [0.5]).collect()


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert st.load_results(spark, f"{tmp_path}/r", f"{tmp_path}/c", ["k"]) is None
    assert st.append_checkpoint(df, f"{tmp_path}/c", "a", 1, ["k"])
    assert st.append_checkpoint(df.withColumn("v", F.lit("new")).where("k = 2"), f"{tmp_path}/c", "b", 1, ["k"])
    assert not st.append_checkpoint(df.orderBy(F.desc("k")).repartition(2), f"{tmp_path}/c", "a", 7, ["k"])  # these scenarios are there
    assert sorted(map(tuple, st.load_results(spark, f"{tmp_path}/r", f"{tmp_path}/c", ["k"]).collect())) == [(1, "a"), (2, "new")]
    st.compact(st.load_results(spark, f"{tmp_path}/r", f"{tmp_path}/c", ["k"]), f"{tmp_path}/r", "2024-01-01T00-00-00", f"{tmp_path}/c")
    assert st.entries(spark, f"{tmp_path}/c") == [] and len(st.contained(spark, f"{tmp_path}/r")) == 2
    assert sorted(map(tuple, st.load_results(spark, f"{tmp_path}/r", f"{tmp_path}/c", ["k"]).collect())) == [(1, "a"), (2, "new")]


def test_newest_rows_keep_all_rows_of_a_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    st.append_checkpoint(df, f"{tmp_path}/c", "a", 0, ["k"])
    st.append_checkpoint(df.where("k = 1").limit(1).withColumn("v", F.lit("new")), f"{tmp_path}/c", "b", 0, ["k"])
    assert sorted(map(str, map(tuple, st.load_checkpoints(spark, f"{tmp_path}/c", ["k"]).collect()))) == ["(1, 'new')", "(2, 'd')", "(None, 'c')"]


def test_snapshots_are_never_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    st.save_results(df, f"{tmp_path}/r", "2024-01-01T00-00-00")
    with pytest.raises(Exception, match="exist"):
        st.save_results(df.withColumn("v", F.lit("b")), f"{tmp_path}/r", "2024-01-01T00-00-00")
    assert st.load_results(spark, f"{tmp_path}/r", f"{tmp_path}/c", ["k"]).collect() == df.collect()


def test_what_a_broken_run_leaves_is_not_read(spark, tmp_path, monkeypatch):
    df, path = spark.createDataFrame([(1, "a")], "k int, v string"), f"{tmp_path}/r"
    st.save_results(df, path, "2024-01-01T00-00-00")
    for fault in ("_write", "_commit"):  # killed before the data are written, and before the rename
        with monkeypatch.context() as m:
            m.setattr(st, fault, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                st.save_results(df.withColumn("v", F.lit("b")), path, "2024-01-02T00-00-00")
        (tmp_path / "r" / "data-left" / "_temporary").mkdir(parents=True, exist_ok=True)
        assert st.load_results(spark, path, f"{tmp_path}/c", ["k"]).collect() == df.collect()
    new = df.withColumn("v", F.lit("c"))
    st.save_results(new, path, "2024-01-02T00-00-00")  # a retry under the same name
    assert st.load_snapshot(spark, path).collect() == new.collect()
    folder = next(m["folder"] for m in st.entries(spark, path) if m["name"] == "2024-01-02T00-00-00")
    next((tmp_path / "r" / folder).glob("*.parquet")).write_bytes(b"damaged")
    with pytest.warns(UserWarning, match="lost files"):
        assert st.load_snapshot(spark, path).collect() == df.collect()  # the newest readable one


def test_gate_by_folder(spark, tmp_path):
    old, new = spark.createDataFrame([(1, 5)], "k int, x int"), spark.createDataFrame([(2, 0.5)], "k int, x double")
    text = spark.createDataFrame([(3, "z")], "k int, x string")
    for number, df in enumerate((old, text, new)):
        st.append_checkpoint(df, f"{tmp_path}/c", "run", number, ["k"])
    load = lambda policy, expected=new.schema: sorted(map(tuple, st.load_checkpoints(spark, f"{tmp_path}/c", ["k"], expected, policy).collect()))
    with pytest.warns(UserWarning, match="another schema"):
        assert load("continue") == [(1, 5.0), (2, 0.5)]  # a wider type is taken, another one isn't
    with pytest.warns(UserWarning, match="another schema"):
        assert load("force") == [(2, 0.5)]
    with pytest.raises(ValueError, match="another schema"):
        load("quit")
    with pytest.warns(UserWarning, match="another schema"):
        assert load("force", old.schema) == [(1, 5)]
    with pytest.raises(ValueError, match="policy"):
        load("else")


def test_resume_computes_only_what_is_missing(spark, tmp_path):
    scenarios, asked = spark.range(6).select(F.col("id").alias("k")), []

    def compute(todo):
        asked.extend(sorted(r["k"] for r in todo.collect()))
        return todo.withColumn("x", F.col("k") * 2)

    paths = (f"{tmp_path}/r", f"{tmp_path}/c")
    sw.resume(spark, scenarios.where("k < 4"), compute, *paths, "2024-01-01T00-00-00", ["k"])
    assert sorted(asked) == [0, 1, 2, 3]
    asked.clear()
    out = sw.resume(spark, scenarios, compute, *paths, "2024-01-02T00-00-00", ["k"])
    assert sorted(asked) == [4, 5]
    want = [(k, 2 * k) for k in range(6)]
    assert sorted(map(tuple, out.select("k", "x").collect())) == want
    with pytest.raises(ValueError, match="snapshot"):
        sw.resume(spark, scenarios, compute, *paths, "2024-01-02T00-00-00", ["k"])
    assert sorted(map(tuple, st.load_results(spark, *paths, ["k"]).select("k", "x").collect())) == want  # the store is whole
    assert sw.resume(spark, scenarios.limit(0), compute, f"{tmp_path}/none", f"{tmp_path}/c", "2024-01-03T00-00-00", ["k"]).count() == 0


def test_resume_takes_up_a_broken_run(spark, tmp_path):
    scenarios, asked = spark.range(40).select(F.col("id").alias("k")), []

    def compute(todo, most=99):
        if len(asked) >= most:
            raise RuntimeError("lost")
        asked.append({r["k"] for r in todo.collect()})
        return todo.withColumn("x", F.col("k") * 2)

    paths = (f"{tmp_path}/r", f"{tmp_path}/c")
    with pytest.raises(RuntimeError, match="lost"):
        sw.resume(spark, scenarios, lambda todo: compute(todo, 2), *paths, "2024-01-01T00-00-00", ["k"], batches=4)
    first = set.union(*asked)
    assert 0 < len(first) < 40
    asked.clear()
    out = sw.resume(spark, scenarios, compute, *paths, "2024-01-02T00-00-00", ["k"], batches=4)
    assert set.union(*asked) == set(range(40)) - first
    assert sorted(map(tuple, out.select("k", "x").collect())) == [(k, 2 * k) for k in range(40)]
    assert st.entries(spark, paths[1]) == []


def test_resume_gives_each_key_once_after_any_break(spark, tmp_path, monkeypatch):
    scenarios, paths = spark.range(30).select(F.col("id").alias("k")), (f"{tmp_path}/r", f"{tmp_path}/c")
    rows = lambda out: sorted(map(tuple, out.select("k", "x").collect()))
    calls = []

    def compute(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return todo.withColumn("x", F.col("k") * 2)

    with pytest.raises(RuntimeError, match="lost"):
        sw.resume(spark, scenarios.where("k < 20"), compute, *paths, "2024-01-01T00-00-00", ["k"], batches=5)
    with monkeypatch.context() as m:  # a retry under its own name, with more scenarios and other batches, killed between save and delete
        m.setattr(sw, "compact", lambda results, path, run_ts, checkpoints: st.save_results(results, path, run_ts, tuple(e["name"] for e in st.entries(spark, checkpoints))))
        out = sw.resume(spark, scenarios, compute, *paths, "2024-01-01T00-00-00", ["k"], batches=3)
        assert rows(out) == [(k, 2 * k) for k in range(30)] and len(st.entries(spark, paths[1])) > 2
    assert sum(calls) == 30 + calls[2]  # nothing that was a checkpoint was computed again
    out = sw.resume(spark, spark.range(33).select(F.col("id").alias("k")), compute, *paths, "2024-01-02T00-00-00", ["k"], batches=2)
    assert rows(out) == [(k, 2 * k) for k in range(33)] and st.entries(spark, paths[1]) == []


def test_resume_passes_the_gate(spark, tmp_path):
    paths, asked = (f"{tmp_path}/r", f"{tmp_path}/c"), []
    st.save_results(spark.createDataFrame([(1, 2, "old")], "k long, x long, tag string"), paths[0], "2024-01-01T00-00-00")

    def compute(todo):
        asked.extend(r["k"] for r in todo.collect())
        return todo.withColumn("x", F.col("k") * 2)

    scenarios = spark.range(1, 3).select(F.col("id").alias("k"))
    own = spark.createDataFrame([], "k long, x long").schema
    with pytest.raises(ValueError, match="another schema"):
        sw.resume(spark, scenarios, compute, *paths, "2024-01-02T00-00-00", ["k"], expected=own, policy="quit")
    out = sw.resume(spark, scenarios, compute, *paths, "2024-01-02T00-00-00", ["k"], expected=own, policy="continue")
    assert asked == [2] and sorted(tuple(r) for r in out.select("k", "x", "tag").collect()) == [(1, 2, "old"), (2, 4, None)]
    asked.clear()
    out = sw.resume(spark, scenarios, compute, *paths, "2024-01-03T00-00-00", ["k"], expected=own, policy="force")
    assert sorted(asked) == [1, 2] and out.columns == ["k", "x"]


def test_scenario_ids_differ(spark):
    rows = spark.createDataFrame([("a|b", "c", None), ("a", "b|c", None), ("a", "b|c", "-"), ("a", "b|c", "null"), ("a", None, "b|c")], "x string, y string, z string")
    ids = [r[0] for r in rows.select(sc.scenario_id(["x", "y", "z"])).collect()]
    assert len(set(ids)) == len(rows.collect()) and rows.select(sc.scenario_id(["x", "y", "z"])).collect()[0][0] == ids[0]


def _plain_counts(value, true, threshold, filtering, matching):
    """n_alerts, n_outbreaks, matched alerts, matched outbreaks of one series; value: by day from 1."""
    raised, day = [], 1
    while day <= len(value):
        if value[day - 1] >= threshold:
            first = day
            while day < len(value) and value[day] >= threshold:
                day += 1
            raised.append((first, day))
        day += 1
    alerts, found = set(), set()
    for j, (x, y) in enumerate(raised):
        for i, (a, b) in enumerate(true):
            if (a <= x <= b or (filtering == mt.ALL_ALERTS and x <= a and y > a)) and not (matching == mt.SINGLE and j in alerts):
                alerts.add(j)
                found.add(i)
    return len(raised), len(true), len(alerts), len(found)


@pytest.mark.parametrize("filtering", [mt.ALL_ALERTS, mt.POST_START])
@pytest.mark.parametrize("matching", [mt.SINGLE, mt.MULTIPLE])
def test_candidate_counts_against_a_double_loop(spark, filtering, matching):
    rng = random.Random(5)
    rows = [(s, d, rng.choice([0, 0, 1, 2, 4, 7]), float(rng.choice([0, 0, 1, 2, 3, 5, 8]))) for s in range(8) for d in range(1, 61)]
    df = spark.createDataFrame(rows, "sim int, day int, incidence long, value double").withColumn("test", F.lit("t"))
    outbreaks = rn.outbreaks(df, rn.OutbreakSpec(2, 2, 5), ["sim"])
    true = {}
    for r in outbreaks.orderBy("sim", "lo").collect():
        true.setdefault(r["sim"], []).append((r["lo"], r["hi"]))
    ready = rn.marked(df, outbreaks, ["sim"])
    inside = {(r["sim"], r["day"]): r["outbreak_idx"] for r in ready.collect()}
    assert inside == {(s, d): next((k for k, (a, b) in enumerate(true.get(s, []), 1) if a <= d <= b), None) for s, d, *_ in rows}
    candidates = [0.0, 0.5, 1.0, 2.5, 3.0, 8.0, 9.0]
    found = sw.candidate_counts(ready, candidates, ["test", "sim"], ["sim"], filtering, matching).collect()
    assert len(found) == 8 * len(candidates)
    for r in found:
        value = [v for s, d, _, v in rows if s == r["sim"]]
        assert tuple(r)[3:] == _plain_counts(value, true.get(r["sim"], []), r["T"], filtering, matching), r


def test_breakpoints_find_the_optimum(spark):
    rows = [(1, d, 8 if 20 <= d <= 30 else 1 + d % 3, 5 * (20 <= d <= 30)) for d in range(1, 61)]
    df = spark.createDataFrame(rows, "sim int, day int, value long, incidence long").withColumns({"value": F.col("value").cast("double"), "test": F.lit("t")})
    outbreaks = rn.outbreaks(df, rn.OutbreakSpec(5, 3, 10), ["sim"])
    points = sw.breakpoints(df, 1.5, ["test"])
    assert sorted(r["T"] for r in points.collect()) == [2.0, 3.0, 8.0]
    best = sw.best(sw.scores(rn.marked(df, outbreaks, ["sim"]), points, ["test", "sim"], ["sim"], "BalancedAccuracy"), ["test"]).first()
    assert (best["T"], best["loss"]) == (8.0, 0.0)


def test_breakpoint_sweep_reaches_large_counts(spark, monkeypatch):
    small = catalog._series(spark, SF)
    monkeypatch.setattr(catalog, "_series", lambda spark, d: small.withColumn("incidence", F.col("incidence") + 100))
    series = catalog._series(spark, SF)
    ready = sw.prepared(se.with_alert_inputs(te.expected_positives(series, [1.0], catalog.ONE_TEST, catalog.SIM), catalog.KEYS), "DailyThreshold")
    values = sorted({r[0] for r in ready.select(F.col("value").cast("double")).where("value >= 1").distinct().collect()})
    assert values[-1] > 40
    outbreaks = rn.outbreaks(series, catalog._spec(series), catalog.SIM)
    ready = ready.join(rn.marked(series, outbreaks, catalog.SIM).select("sim", "day", "outbreak_idx"), ["sim", "day"])
    scored = sw.scores(ready, values, catalog.KEYS, catalog.SIM, "BalancedAccuracy").where("loss is not null")
    want = min((r["loss"], r["T"]) for r in scored.collect())
    found = catalog.QUERIES["o3_breakpoint_sweep"](spark, SF).first()
    assert (found["loss"], found["T"]) == want


def test_bootstrap_interval(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("v"))
    row = rp.bootstrap(df, "id", "v", 300).first()
    assert row["mean"] == 9.5 and row["low"] < 9.5 < row["high"] and 0.6 < row["high"] - row["low"] < 1.8
    assert rp.bootstrap(df.limit(0), "id", "v", 50).first()["mean"] is None


def test_bootstrap_interval_equals_plain_replicates(spark):
    """The interval from each replicate's weighted mean in turn, with jackknife means for the acceleration."""
    n, replicates, normal = 150, 200, statistics.NormalDist()
    df = spark.range(n).select("id", F.pow(F.col("id") % 13, 2.0).alias("v"), F.xxhash64(F.lit(1), "id").alias("h"))
    rows = df.orderBy("id").collect()
    v, h = np.array([r["v"] for r in rows]), np.array([r["h"] for r in rows]).view(np.uint64)
    chance = [math.exp(-1) / math.factorial(k) for k in range(18)]
    means = []
    for r in range(1, replicates + 1):
        u = rp.uniforms(h ^ np.uint64(r * 0x9E3779B97F4A7C15 % 2**64))
        weight = np.array([next((k for k in range(18) if x < sum(chance[: k + 1])), 18) for x in u])
        means.append((weight * v).sum() / weight.sum())
    jack = (v.sum() - v) / (n - 1)
    d = jack.mean() - jack
    z0, a = normal.inv_cdf(np.mean(np.array(means) < v.mean())), (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    ends = [np.quantile(means, normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q))))) for q in (0.025, 0.975)]
    found = rp.bootstrap(df, "id", "v", replicates).first()
    assert found["mean"] == pytest.approx(v.mean()) and (found["low"], found["high"]) == pytest.approx(tuple(ends), rel=1e-9)
