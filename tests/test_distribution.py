import math
import random

import pytest
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.mllib.stat import KernelDensity
from pyspark.sql import functions as F

from ashlar.functions.numbers import kolmogorov_survival, normal_cdf
from ashlar.operators import distribution as D
from ashlar.operators.profile import fit


def exact_ks(values, stats):
    values = sorted(values)
    n, worst = len(values), 0.0
    for i, v in enumerate(values):
        p = 0.5 * math.erfc(-(v - stats.mean) / stats.stddev / math.sqrt(2))
        worst = max(worst, (i + 1) / n - p, p - i / n)
    return worst


def sample(kind, n=3000, seed=5):
    draw = random.Random(seed)
    if kind == "normal":
        return [draw.gauss(3, 2) for _ in range(n)]
    if kind == "exponential":
        return [draw.expovariate(0.2) for _ in range(n)]
    if kind == "hot":  # a third of all rows share one value
        return [1.25 if i % 3 == 0 else draw.gauss(0, 1) for i in range(n)]
    # One giant value squeezes all others into a single bucket.
    return [1e9 if i == 0 else draw.random() for i in range(n)]


def test_normal_cdf(spark):
    points = [x / 8 for x in range(-320, 321)]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    for row in df.select("x", normal_cdf(F.col("x")).alias("p")).collect():
        assert row.p == pytest.approx(0.5 * math.erfc(-row.x / math.sqrt(2)), abs=2e-15, rel=1e-8)


@pytest.mark.parametrize("kind", ["normal", "exponential", "hot", "giant"])
@pytest.mark.parametrize("buckets", [8, None])
def test_ks_statistic_is_exact(spark, kind, buckets):
    values = sample(kind)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    stats = fit(df, ["v"])
    found = D.ks_normal(df, ["v"], stats, p_value=False, buckets=buckets).first()
    assert found.n == len(values)
    assert found.statistic == pytest.approx(exact_ks(values, stats["v"]), abs=1e-13)


@pytest.mark.parametrize("n", [20, 140, 141, 3000])
def test_ks_agrees_with_ml(spark, n):
    df = spark.createDataFrame([(v,) for v in sample("normal", n)], "v double")
    stats = fit(df, ["v"])
    reference = KolmogorovSmirnovTest.test(df, "v", "norm", stats["v"].mean, stats["v"].stddev).first()
    found = D.ks_normal(df, ["v"], stats).first()
    assert found.statistic == pytest.approx(reference.statistic, abs=1e-12)
    assert found.p_value == pytest.approx(reference.pValue, abs=1e-7)
    assert found.p_value > 0.01


def test_ks_on_several_columns_and_constants(spark, numbers):
    found = {r["column"]: r.statistic for r in D.ks_normal(numbers, p_value=False).collect() if r["column"] != "id"}
    stats = fit(numbers)
    for name in ("plain", "whole", "hot"):
        values = [r[0] for r in numbers.select(name).collect()]
        assert found[name] == pytest.approx(exact_ks(values, stats[name]), abs=1e-13)
    assert "constant" not in found and "zero" not in found


@pytest.mark.parametrize("kind", ["giant", "normal"])
def test_open_buckets_are_cut_between_their_own_ends(spark, monkeypatch, kind):
    """One value of 1e9 beside 300,000 normal ones squeezes these into a bucket or two."""
    values = [1e9 if i == 0 and kind == "giant" else v for i, v in enumerate(sample("normal", 300_000))]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4).cache()
    stats = fit(df, ["v"])
    ranked, real = [], D._ranked
    monkeypatch.setattr(D, "_ranked", lambda v, open_, n: ranked.append(int(open_.size.sum())) or real(v, open_, n))
    found = D.ks_normal(df, ["v"], stats, p_value=False).first()
    assert found.statistic == pytest.approx(exact_ks(values, stats["v"]), abs=1e-13)
    assert sum(ranked) < 10_000


@pytest.mark.parametrize("kind", ["normal", "giant", "hot"])
def test_many_levels_and_few_cells(spark, monkeypatch, kind):
    for name, value in (("KS_ROWS", 3), ("KS_PARTS", 4), ("KS_CELLS", 64)):
        monkeypatch.setattr(D, name, value)
    values = sample(kind, 2000)
    df = spark.createDataFrame([(v, -v) for v in values], "v double, w double").repartition(3)
    stats = fit(df, ["v", "w"])
    for r in D.ks_normal(df, ["v", "w"], stats, p_value=False, buckets=4).collect():
        side = values if r["column"] == "v" else [-v for v in values]
        assert r.statistic == pytest.approx(exact_ks(side, stats[r["column"]]), abs=1e-13)


def test_kolmogorov_tail_matches_the_logged_run():
    # A published run on 9,999 rows: statistic and p-value.
    assert kolmogorov_survival(0.005495681749849268, 9999) == pytest.approx(0.9216108887428276, abs=1e-6)
    assert kolmogorov_survival(0.00481147279958305, 9999) == pytest.approx(0.9739061510535695, abs=1e-6)
    assert kolmogorov_survival(0.006841164329134175, 9999) == pytest.approx(0.7348239656222796, abs=1e-6)
    assert kolmogorov_survival(0.0, 5) == 1.0 and kolmogorov_survival(1.0, 5) == 0.0


def test_kde_agrees_with_mllib(spark, numbers):
    points = [-2.0, 0.0, 3.5, 10.0]
    values = numbers.rdd.map(lambda r: r.plain)
    density = KernelDensity()
    density.setSample(values)
    density.setBandwidth(3.0)
    reference = density.estimate(points)
    found = {r.point: r.density for r in D.kde(numbers, ["plain"], points=points).collect()}
    assert [found[p] for p in points] == pytest.approx(list(reference), rel=1e-13)


def test_kde_grid_equals_the_full_sum(spark):
    values = [0.0, 1.0, 5.5, 900.0, -300.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = D.kde(df, ["v"], grid=(-10.0, 2.5, 300)).orderBy("point").collect()
    assert len(found) == 300
    for row in found:
        full = sum(math.exp(-0.5 * ((row.point - v) / 3) ** 2) for v in values) / (5 * 3 * math.sqrt(2 * math.pi))
        assert row.density == pytest.approx(full, rel=1e-12, abs=1e-15) and row.density >= 0
    kept = D.kde(df, ["v"], grid=(-10.0, 2.5, 300), least=0.01).collect()
    assert sorted(r.point for r in kept) == [r.point for r in found if r.density >= 0.01]


def test_kde_by_cells_equals_the_direct_sum(spark):
    values = sample("hot", 4000) + sample("exponential", 4000)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for options in ({"grid": (-60.0, 1.0, 150)}, {"grid": (5.0, 0.01, 40)}, {"points": [-400.0, -9.5, 0.0, 1.25, 40.0]}):
        found = D.kde(df, ["v"], **options).collect()
        assert len(found) == (options["grid"][2] if "grid" in options else len(options["points"]))
        for r in found:
            full = math.fsum(math.exp(-0.5 * ((r.point - v) / 3) ** 2) for v in values) / (8000 * 3 * math.sqrt(2 * math.pi))
            assert r.density == pytest.approx(full, rel=1e-11, abs=1e-15)


def test_listed_points_meet_only_cells_near_them(spark):
    # Cells over a wide range: the join is by cell, and no cell is paired with all points.
    df = spark.range(3000).selectExpr("double(id) * 50 AS v")
    plan = D.kde(df, ["v"], points=[0.0, 75_000.0])._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin [cell" in plan or "SortMergeJoin [cell" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    found = {r.point: r.density for r in D.kde(df, ["v"], points=[0.0, 75_000.0]).collect()}
    assert found[75_000.0] == pytest.approx((1 + 2 * math.exp(-0.5 * (50 / 3) ** 2)) / (3000 * 3 * math.sqrt(2 * math.pi)))


def test_kde_far_from_all_values_is_zero(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(1000)], "v double")
    far = D.kde(df, ["v"], grid=(500.0, 1.0, 20)).collect()
    assert len(far) == 20 and {r.density for r in far} == {0.0}
    assert D.kde(df, ["v"], points=[-1e6, 1e6, *range(10)]).filter("abs(point) = 1e6 and density <> 0").count() == 0


def test_default_grids():
    assert D.default_grid(9999) == (0.0, 99.0, 99)
    assert D.unit_grid(7) == (0.0, 1.0, 7)


def test_kde_of_normal_data_is_a_wider_normal(spark):
    df = spark.createDataFrame([(v,) for v in sample("normal", 20000)], "v double")
    for row in D.kde(df, ["v"], points=[0.0, 3.0, 6.0]).collect():
        spread = math.sqrt(4 + 9)
        expected = math.exp(-0.5 * ((row.point - 3) / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
        assert row.density == pytest.approx(expected, abs=0.002)
