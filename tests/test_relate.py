import pytest
from pyspark.ml.stat import Correlation
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.stat import Statistics

from ashlar.functions.numbers import _upper_gamma
from ashlar.operators import relate

COLUMNS = ["plain", "whole", "hot"]


def test_correlation_agrees_with_ml(spark, numbers):
    matrix = Correlation.corr(relate.vectorize(numbers, COLUMNS), "features").first()[0].toArray()
    found = {(r.col_i, r.col_j): r.r for r in relate.correlation(numbers, COLUMNS).collect()}
    assert len(found) == 9
    for i, a in enumerate(COLUMNS):
        for j, b in enumerate(COLUMNS):
            assert found[a, b] == pytest.approx(matrix[i, j], abs=1e-12)


@pytest.mark.parametrize("others", [2, 20])
def test_correlation_is_the_same_in_tables_of_any_width(spark, others):
    """A constant column has none, one of tiny spread has its own."""
    rows = spark.range(500).selectExpr(
        "7.1D AS constant", "(id % 11) * 1e-8D AS tiny", *[f"double((id * {k + 3}) % 101) AS x{k}" for k in range(others)]
    ).repartition(5)
    found = {(r.col_i, r.col_j): r.r for r in relate.correlation(rows, rows.columns).collect()}
    assert len(found) == (others + 2) ** 2
    assert all(r is None for pair, r in found.items() if "constant" in pair)
    assert found["tiny", "tiny"] == found["x0", "x0"] == 1.0
    values = rows.select("tiny", "x0", "x1").toPandas()
    assert found["tiny", "x0"] == found["x0", "tiny"] == pytest.approx((values.tiny * 1e8).corr(values.x0), abs=1e-12)
    assert found["x0", "x1"] == pytest.approx(values.x0.corr(values.x1), abs=1e-12)


def test_correlation_waits_until_it_is_asked_for(spark):
    rows = spark.range(10).selectExpr("id AS a", "raise_error('read too early') AS b")
    assert relate.correlation(rows, ["a", "b"]).columns == ["col_i", "col_j", "r"]
    assert relate.correlation(spark.range(0).selectExpr("id AS a", "id AS b"), ["a", "b"]).count() == 0


def test_correlation_takes_one_scan_and_merges_in_two_steps(spark, folder):
    spark.range(100).selectExpr("double(id) AS a", "double(id % 7) AS b").write.parquet(f"{folder}/t")
    plan = relate.correlation(spark.read.parquet(f"{folder}/t"), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


@pytest.mark.parametrize("side", [1, 3, 64])
def test_correlation_by_tiles_of_any_size(spark, monkeypatch, side):
    monkeypatch.setattr(relate, "TILE", side)
    rows = spark.range(400).selectExpr("5D AS c0", *[f"double((id * {k + 3}) % 101) + 1e6 AS c{k}" for k in range(1, 7)]).repartition(6)
    values = rows.toPandas()
    found = {(r.col_i, r.col_j): r.r for r in relate.correlation(rows, rows.columns).collect()}
    assert len(found) == 49
    for (a, b), r in found.items():
        if "c0" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(1.0 if a == b else values[a].corr(values[b]), abs=1e-10)


def test_correlated_pairs_name_the_later_column_first(spark):
    df = spark.range(50).selectExpr("double(id) a", "double(-2 * id) b", "double(id % 2) c")
    pairs = [(r.col_i, r.col_j, round(r.r, 9)) for r in relate.correlated_pairs(df, ["a", "b", "c"]).collect()]
    assert pairs == [("b", "a", -1.0)]


def test_independence_agrees_with_mllib(spark):
    rows = [(10.0, -20.0, 5.0), (20.0, 20.0, 1.0), (30.0, 21.0, 9.0), (3.0, 4.0, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    column_major = [abs(r[j]) for j in range(3) for r in rows]
    reference = Statistics.chiSqTest(Matrices.dense(4, 3, column_major))
    found = relate.chi2_independence(df, ["a", "b", "c"]).first()
    assert found.statistic == pytest.approx(reference.statistic)
    assert found.df == reference.degreesOfFreedom
    assert found.p_value == pytest.approx(reference.pValue)


def test_independence_skips_zero_rows_and_columns(spark):
    rows = [(10.0, 20.0, 0.0), (0.0, 0.0, 0.0), (30.0, 21.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = relate.chi2_independence(df, ["a", "b", "c"]).first()
    reference = Statistics.chiSqTest(Matrices.dense(2, 2, [10.0, 30.0, 20.0, 21.0]))
    assert (found.df, found.zero_rows) == (1, 1)
    assert found.statistic == pytest.approx(reference.statistic)


def test_goodness_of_fit_agrees_with_mllib(spark, numbers):
    for name in ("plain", "whole", "hot"):
        values = [float(r[0]) - 3 for r in numbers.select(name).collect()]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        shift = max(0.0, -min(values))
        observed = OldVectors.dense([v + shift for v in values])
        expected = OldVectors.dense([v + shift + 1 for v in values])
        reference = Statistics.chiSqTest(observed, expected)
        found = relate.chi2_gof(df, ["v"]).first()
        assert found.statistic == pytest.approx(reference.statistic)
        assert found.df == reference.degreesOfFreedom
        assert found.p_value == pytest.approx(reference.pValue, abs=1e-10)


def test_chi_square_tail():
    # Known values of the chi-square survival function.
    assert _upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert _upper_gamma(5.0, 18.307038053275146 / 2) == pytest.approx(0.05)
    assert _upper_gamma(50.0, 77.92946516501728 / 2) == pytest.approx(0.95, abs=1e-6)
    assert _upper_gamma(1e7, 1e7) == pytest.approx(_upper_gamma(1.0000001e7, 1.0000001e7), abs=1e-6)
