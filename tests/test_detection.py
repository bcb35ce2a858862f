"""Literal cases of the detection operators, and a double loop against the DataFrames on random series."""

import datetime
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.functions import labels
from tocsin.operators import matching as mt
from tocsin.operators import metrics as me
from tocsin.operators import runs as rn
from tocsin.operators import series as se
from tocsin.operators import slices as sl
from tocsin.operators import testing as te
from tocsin.sources import series as src

SIM = ["sim"]


def series(spark, values, sim=1, name="incidence"):
    return spark.createDataFrame([(sim, d, v) for d, v in enumerate(values, 1)], f"sim int, day int, {name} {'double' if isinstance(values[0], float) else 'long'}")


def bounds(df):
    return [(r["lo"], r["hi"]) for r in df.orderBy("sim", "lo").collect()]


def intervals(spark, index, found, sim=1):
    return spark.createDataFrame([(sim, k, a, b, b - a + 1) for k, (a, b) in enumerate(found, 1)], f"sim int, {index} int, lo int, hi int, duration int")


STEPS = [9 * [1], 51 * [12], 19 * [1], 11 * [15], 9 * [1], 81 * [8], 199 * [1], 31 * [30], 89 * [1], 41 * [25]]


def test_outbreaks(spark):
    df = series(spark, sum(STEPS, []))
    spec = rn.OutbreakSpec(5, 30, 500)
    assert [(r["lo"], r["hi"], r["duration"], r["status"]) for r in rn.outbreak_runs(df, spec, SIM).orderBy("lo").collect()] == [
        (10, 60, 51, 1), (80, 90, 11, 0), (100, 180, 81, 1), (380, 410, 31, 1), (500, 540, 41, 1)
    ]
    assert [(r["outbreak_idx"], r["size"]) for r in rn.outbreaks(df, spec, SIM).orderBy("lo").collect()] == [(1, 612), (2, 648), (3, 930), (4, 1025)]
    status = rn.outbreak_status(df, spec, SIM).where("status = 1").agg(F.count("*"), F.min("day"), F.max("day")).first()
    assert tuple(status) == (51 + 81 + 31 + 41, 10, 540)


@pytest.mark.parametrize(("values", "want"), [(9 * [1] + 20 * [15] + 70 * [1], []), (9 * [1] + 40 * [8] + 50 * [1], []), (40 * [15] + 59 * [1], [(1, 40)]), (59 * [1] + 40 * [15], [(60, 99)]), (99 * [15], [(1, 99)])])
def test_outbreak_edges(spark, values, want):
    assert bounds(rn.outbreaks(series(spark, values), rn.OutbreakSpec(5, 30, 500), SIM)) == want


def test_series_without_outbreak(spark):
    df = series(spark, [10] * 20).union(series(spark, [2] * 20, 2))
    found = rn.outbreaks(df, rn.OutbreakSpec(5, 7, 50), SIM)
    with pytest.raises(ValueError, match="1 series.*'sim': 2"):
        rn.require_outbreaks(df.select("sim").distinct(), found, SIM)


@pytest.mark.parametrize(("t", "want"), [(7.0, [(4, 6)]), (12.0, [(5, 5)]), (20.0, [])])
def test_alerts(spark, t, want):
    df = series(spark, [0, 0, 5, 10, 15, 8, 3, 0, 0, 0], name="test_pos")
    assert bounds(rn.runs(df.where(F.col("test_pos") >= t), SIM, "alert_idx")) == want


def test_reporting_lag(spark):
    df = series(spark, [0, 5, 10, 15, 20, 0, 0, 0, 0, 0]).withColumn("noise", F.lit(0))
    out = te.expected_positives(df, [1.0], [te.TestSpec(1.0, 1.0, 2), te.TestSpec(1.0, 1.0, 0)], SIM)
    for lag, want in ((2, [0, 0, 0, 5, 10, 15, 20, 0, 0, 0]), (0, [0, 5, 10, 15, 20, 0, 0, 0, 0, 0])):
        assert [r["true_pos"] for r in out.where(F.col("test_lag") == lag).orderBy("day").collect()] == want


def pairs_of(spark, outbreaks, alerts, filtering=mt.ALL_ALERTS, matching=mt.SINGLE):
    pairs = mt.matches(intervals(spark, "alert_idx", alerts), intervals(spark, "outbreak_idx", outbreaks), SIM, None, filtering, matching)
    return sorted((r["outbreak_idx"], r["alert_idx"]) for r in pairs.collect())


@pytest.mark.parametrize(
    ("outbreaks", "alerts", "want"),
    [
        ([(10, 30), (50, 70)], [(15, 25), (55, 65)], [(1, 1), (2, 2)]),
        ([(10, 20), (30, 40), (50, 60)], [(15, 55)], [(1, 1)]),
        ([(10, 50)], [(15, 20), (25, 30), (35, 40)], [(1, 1), (1, 2), (1, 3)]),
        ([(10, 20)], [(10, 15)], [(1, 1)]),
        ([(10, 20)], [(15, 20)], [(1, 1)]),
        ([(10, 20)], [(21, 25)], []),
        ([(10, 20)], [(5, 10)], []),
    ],
)
def test_matches(spark, outbreaks, alerts, want):
    assert pairs_of(spark, outbreaks, alerts) == want


def test_match_strategies(spark):
    assert pairs_of(spark, [(10, 20), (30, 40), (50, 60)], [(15, 55)], matching=mt.MULTIPLE) == [(1, 1), (2, 1), (3, 1)]
    assert pairs_of(spark, [(20, 40), (60, 80)], [(15, 25), (25, 35), (55, 65), (65, 75)]) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert pairs_of(spark, [(20, 40), (60, 80)], [(15, 25), (25, 35), (55, 65), (65, 75)], mt.POST_START) == [(1, 2), (2, 4)]


def test_undefined_ratios(spark):
    row = spark.range(1).select(
        me.balanced(F.lit(0.8), F.lit(0.6)).alias("a"), me.balanced(F.lit(None).cast("double"), F.lit(0.5)).alias("b"), me.balanced(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("c"),
        me.f_beta(F.lit(0.8), F.lit(0.6)).alias("d"), me.f_beta(F.lit(0.0), F.lit(0.0)).alias("e"), me.f_beta(F.lit(None).cast("double"), F.lit(0.5)).alias("f"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["e"], row["f"]) == (0.7, 0.5, None, 0.0, 0.0)
    assert row["d"] == pytest.approx(0.6857142857142857)


def test_unavoidable_cases(spark):
    values = [0] * 60
    values[9:14], values[14:20], values[29:40], values[49:60] = [10] * 5, [5] * 6, [15] * 11, [20] * 11
    df, outbreaks, alerts = series(spark, values), intervals(spark, "outbreak_idx", [(10, 20), (30, 40), (50, 60)]), intervals(spark, "alert_idx", [(15, 18)])
    firsts = mt.first_alerts(mt.matches(alerts, outbreaks, SIM), SIM)
    assert [r["cases"] for r in me.unavoidable(df, outbreaks, firsts, SIM).orderBy("outbreak_idx").collect()] == [50, 165, 220]
    assert [r["delay"] for r in me.delays(firsts, SIM).collect()] == [5]


def test_against_a_double_loop(spark):
    rng = random.Random(4)
    rows = [(s, d, rng.choice([0, 0, 1, 3, 6, 9])) for s in range(12) for d in range(1, 81)]
    df = spark.createDataFrame(rows, "sim int, day int, incidence long")
    value = {(s, d): v for s, d, v in rows}

    def runs(flag, s):
        out, day = [], 1
        while day <= 80:
            if flag(value[s, day]):
                first = day
                while day < 80 and flag(value[s, day + 1]):
                    day += 1
                out.append((first, day))
            day += 1
        return out

    outbreaks = rn.outbreaks(df, rn.OutbreakSpec(3, 2, 8), SIM)
    alerts = rn.runs(df.where("incidence >= 6"), SIM, "alert_idx")
    for filtering in (mt.ALL_ALERTS, mt.POST_START):
        for matching in (mt.SINGLE, mt.MULTIPLE):
            pairs = mt.matches(alerts, outbreaks, SIM, None, filtering, matching)
            got = sorted(tuple(r) for r in pairs.select("sim", "outbreak_idx", "alert_idx").collect())
            firsts = mt.first_alerts(pairs, SIM)
            cases = {(r["sim"], r["outbreak_idx"]): r["cases"] for r in me.unavoidable(df, outbreaks, firsts, SIM).collect()}
            want, lost = [], {}
            for s in range(12):
                true = [(a, b) for a, b in runs(lambda v: v >= 3, s) if b - a + 1 >= 2 and sum(value[s, d] for d in range(a, b + 1)) >= 8]
                raised, used = runs(lambda v: v >= 6, s), set()
                for i, (a, b) in enumerate(true, 1):
                    own = []
                    for j, (x, y) in enumerate(raised, 1):
                        hit = a <= x <= b or (filtering == mt.ALL_ALERTS and x <= a and y > a)
                        if hit and not (matching == mt.SINGLE and j in used):
                            used.add(j)
                            own.append(x)
                            want.append((s, i, j))
                    end = b if not own else max(own[0], a) - 1
                    lost[s, i] = sum(value[s, d] for d in range(a, end + 1))
            assert got == sorted(want)
            assert cases == lost


def test_draws_do_not_depend_on_partitions(spark):
    df = series(spark, [20] * 50).withColumn("noise", F.lit(9))
    test = [te.TestSpec(0.9, 0.9, 0)]
    one = te.drawn_positives(df.repartition(1), [0.5], test, SIM).orderBy("day").collect()
    many = te.drawn_positives(df.repartition(5), [0.5], test, SIM).orderBy("day").collect()
    assert one == many


def test_draws_follow_their_distributions():
    seed = np.arange(40_000)
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.93), (2000, 0.2), (5, 0.0), (5, 1.0)):
        x = se.binomial(seed, np.full(len(seed), n), np.full(len(seed), p))
        assert x.min() >= 0 and x.max() <= n
        assert abs(x.mean() - n * p) <= 5 * (n * p * (1 - p) / len(seed)) ** 0.5 and abs(x.var() - n * p * (1 - p)) <= 0.06 * n * p * (1 - p)
    for mean in (0.0, 0.4, 6.0, 90.0, 1300.0):
        x = se.poisson(seed, np.full(len(seed), mean))
        assert abs(x.mean() - mean) <= 5 * (mean / len(seed)) ** 0.5 and abs(x.var() - mean) <= 0.06 * mean
    share = np.bincount(se.binomial(seed, np.full(len(seed), 3), np.full(len(seed), 0.25)), minlength=4) / len(seed)
    assert np.allclose(share, [0.421875, 0.421875, 0.140625, 0.015625], atol=0.01)


@pytest.mark.parametrize(("n", "p"), [(30, 0.4), (25, 0.7), (200, 0.06), (100, 0.5), (1000, 0.97)])
def test_binomial_draws_by_chi_square(n, p):
    x = se.binomial(np.arange(200_000) + 7, np.full(200_000, n), np.full(200_000, p))
    chance = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(n + 1)])
    assert _chi_square_fits(np.bincount(x, minlength=n + 1), chance)


@pytest.mark.parametrize("mean", [3.0, 10.0, 11.5, 40.0, 300.0])
def test_poisson_draws_by_chi_square(mean):
    x = se.poisson(np.arange(200_000) + 9, np.full(200_000, mean))
    top = max(int(x.max()), int(mean + 12 * mean**0.5)) + 1
    chance = np.array([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(top + 1)])
    assert _chi_square_fits(np.bincount(x, minlength=top + 1), chance)


def _chi_square_fits(counts, chance):
    """Whether counts fit the chances of all values, rare ones in one class; five standard deviations are allowed."""
    want = chance * counts.sum()
    often = want >= 20
    seen, want = np.append(counts[often], counts[~often].sum()), np.append(want[often], max(want[~often].sum(), 1e-9))
    seen, want = (seen, want) if want[-1] >= 5 else (seen[:-1], want[:-1])
    return ((seen - want) ** 2 / want).sum() < (len(want) - 1) + 5 * (2 * (len(want) - 1)) ** 0.5


def test_draws_of_many_trials_take_constant_memory():
    seed = np.arange(20_000)
    tracemalloc.start()
    for n, p in ((10**9, 0.3), (10**9, 1e-9), (10**12, 0.5), (10**9, 1 - 1e-4)):
        x = se.binomial(seed, np.full(len(seed), n), np.full(len(seed), p))
        assert abs(x.mean() - n * p) <= 5 * (n * p * (1 - p) / len(seed)) ** 0.5 and abs(x.var() / (n * p * (1 - p)) - 1) <= 0.06
    x = se.poisson(seed, np.full(len(seed), 3e9))
    assert abs(x.mean() - 3e9) <= 5 * (3e9 / len(seed)) ** 0.5 and abs(x.var() / 3e9 - 1) <= 0.06
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_days_reach_as_far_as_the_counts(spark):
    """No axis is given beforehand: dates of any century are in it; given bounds that counts cross are an error."""
    events = spark.createDataFrame([("a", "1871-03-05"), ("a", "1871-03-05"), ("b", "1871-03-01"), ("b", "2031-12-31"), ("a", None)], "sim string, date string").withColumn("date", F.col("date").cast("date"))
    counts = src.numbered_days(src.count_series(events, SIM, F.col("date"), incidence=F.lit(True)))
    dense = src.dense_days(counts, events.select("sim").distinct(), SIM, ["incidence"])
    row = dense.agg(F.count("*"), F.min("day"), F.max("day"), F.sum("incidence")).first()
    days = (datetime.date(2031, 12, 31) - datetime.date(1871, 3, 1)).days + 1
    assert tuple(row) == (2 * days, 1, days, 4)
    assert dense.where("sim = 'a' and day = 5").first()["incidence"] == 2
    inside = src.dense_days(counts.where("day < 9"), events.select("sim").distinct(), SIM, ["incidence"], (1, 9))
    assert inside.count() == 18
    with pytest.raises(Exception, match="outside the days"):
        src.dense_days(counts, events.select("sim").distinct(), SIM, ["incidence"], (1, 9)).collect()
    assert src.dense_days(counts.limit(0), events.select("sim").distinct(), SIM, ["incidence"]).count() == 0


def test_several_outbreak_specs(spark):
    df = series(spark, sum(STEPS, []))
    specs = [rn.OutbreakSpec(5, 30, 500), rn.OutbreakSpec(10, 5, 100), rn.OutbreakSpec(40, 1, 1)]
    found = sorted((r["outbreak_spec"], r["outbreak_idx"], r["lo"], r["hi"], r["size"]) for r in rn.outbreaks(df, specs, SIM).collect())
    assert found == [(k, r["outbreak_idx"], r["lo"], r["hi"], r["size"]) for k, spec in enumerate(specs, 1) for r in rn.outbreaks(df, spec, SIM).orderBy("lo").collect()]


def test_combine_refuses_other_lengths(spark):
    a, b = series(spark, [1, 2, 3]), series(spark, [1, 2], name="noise")
    with pytest.raises(Exception, match="differ in number or length"):
        se.combine(a, b, SIM).collect()


def test_labels(spark):
    kinds = ["poisson", "static", "dynamical_inphase", "dynamic", "custom_noise"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(labels.noise_label(F.col("k"))).collect()] == ["Static Noise", "Static Noise", "Dynamical Noise", "Dynamical Noise", "Custom_Noise"]
    with pytest.raises(Exception, match="unknown test"):
        spark.range(1).select(labels.table_label(F.lit(0.5), F.lit(0.7), F.lit(3))).collect()


def test_slices_equal_whole_series(spark):
    rng = random.Random(12)
    rows = [(s, d, 9 if s == 3 else rng.choice([0, 0, 3, 5, 9]) if s else 0) for s in range(4) for d in range(1, 131)]  # one run over all slices, one series without any
    df = spark.createDataFrame(rows, "sim int, day int, incidence long").repartition(5)
    spec, flagged = rn.OutbreakSpec(3, 2, 10), df.where("incidence >= 3")
    for size in (1, 7, 10, 1000):
        mean = sl.trailing_mean(df, SIM, "incidence", 5, "m", size).select("sim", "day", "m")
        assert sorted(mean.collect()) == sorted(df.select("sim", "day", se.trailing_mean(F.col("incidence"), 5, SIM).alias("m")).collect())
        assert sorted(sl.runs(flagged, SIM, "k", {"total": F.col("incidence")}, size).collect()) == sorted(rn.runs(flagged, SIM, "k", total=F.col("incidence")).collect())
        assert sorted(sl.outbreak_status(df, spec, SIM, size).collect()) == sorted(rn.outbreak_status(df, spec, SIM).collect())
        upto = {(r["sim"], r["day"]): r["u"] for r in sl.running_sum(df, SIM, "incidence", "u", size).collect()}
        assert upto == {(s, d): sum(v for x, e, v in rows if x == s and e <= d) for s, d, _ in rows}


def test_one_series_of_ten_million_days(spark):
    n = 10_000_000
    df = spark.range(1, n + 1, numPartitions=16).select(F.lit(1).alias("sim"), F.col("id").cast("int").alias("day"), F.when(F.col("id") % 1000 < 600, 2).otherwise(0).cast("long").alias("incidence"))
    found = sl.runs(df.where("incidence > 0"), SIM, "k", {"total": F.col("incidence")})
    row = found.agg(F.count("*"), F.max("k"), F.sum("duration"), F.min("duration"), F.max("total"), F.count_distinct("k")).first()
    # days 1 to 599, then 600 days at a time, the last day alone
    assert tuple(row) == (n // 1000 + 1, n // 1000 + 1, 6 * n // 10, 1, 1200, n // 1000 + 1)
    assert df.groupBy(sl.slice_of(F.col("day")).alias("s")).count().agg(F.count("*"), F.max("count")).first()[:] == (-(-n // sl.SLICE), sl.SLICE)
