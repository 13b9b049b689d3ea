import random

import pytest

from ashlar.operators import ranks
from ashlar.operators.profile import fit


def frame(spark, values, partitions=3):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(partitions)


CASES = {
    "odd": [5, 1, 4, 2, 3],
    "even": [6, 5, 1, 4, 2, 3],
    "one": [9.5],
    "two": [2, 1],
    "ties": [1] * 40 + [2] * 41 + [3] * 40,
    "third": [7.5 if i % 3 == 0 else i / 10 for i in range(301)],
    "skewed": [10.0 ** (i % 30) for i in range(500)],
    "random": [random.Random(3).gauss(0, 1) for _ in range(1)] + [random.Random(i).gauss(0, 1) for i in range(999)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("limit", [1, 20, 100_000])
def test_medians_are_exact(spark, case, limit):
    values = sorted(CASES[case])
    df = frame(spark, values)
    upper = ranks.median(df, ["v"], "upper", limit=limit).first().median
    lower = ranks.median(df, ["v"], "lower", limit=limit).first().median
    half = len(values) // 2
    assert upper == values[half]
    assert lower == (values[half - 1] if len(values) > 1 else None)


def test_rough_percentiles_cost_rounds_not_correctness(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 40)
    values = CASES["random"]
    assert ranks.median(frame(spark, values), ["v"], limit=5).first().median == sorted(values)[500]


def test_every_rank_of_several_columns(spark):
    df = spark.range(60).selectExpr("double(pmod(id * 37, 60)) + 1 AS a", "double(id % 4) + 1 AS b").repartition(4)
    stats = fit(df, ["a", "b"])
    ordered = {c: sorted(r[0] for r in df.select(c).collect()) for c in ("a", "b")}
    for k in (1, 2, 15, 16, 59, 60):
        found = ranks.order_statistic(df, ["a", "b"], lambda n, k=k: k, stats, limit=4).collect()
        assert {r["column"]: r.value for r in found} == {c: ordered[c][k - 1] for c in ordered}


def test_histogram_has_an_extra_bin_for_the_maximum(spark):
    rows = [(r.bin, r["count"]) for r in ranks.histogram(frame(spark, [1, 1, 2, 9, 9.5, 10, 10, 10, 4]), ["v"]).orderBy("bin").collect()]
    assert rows == [(0, 3), (1, 1), (2, 2), (3, 3)]  # width 3: [1,4), [4,7), [7,10), 10


def test_constant_column_goes_to_bin_zero(spark):
    rows = [(r.bin, r["count"]) for r in ranks.histogram(frame(spark, [4.5] * 9), ["v"]).orderBy("bin").collect()]
    assert rows == [(0, 9), (1, 0), (2, 0), (3, 0)]
    assert ranks.mode(frame(spark, [4.5] * 9), ["v"]).first().mode == 4.5


def test_mode_is_the_lowest_of_the_fullest_bins(spark):
    values = [0, 0.1, 0.2, 5, 5.1, 5.2, 9, 3, 2.5]  # bins [0,3) 4, [3,6) 4, [6,9) 0, 9 1
    df = frame(spark, values)
    assert ranks.mode(df, ["v"]).first().mode == 0.0
    order = [(r["rank"], r.left_edge, r["count"]) for r in ranks.ranked_modes(df, ["v"]).orderBy("rank").collect()]
    assert order == [(1, 0.0, 4), (2, 3.0, 4), (3, 9.0, 1)]
    edges = [(r["rank"], r.left_edge, r["count"]) for r in ranks.histogram_edges(df, ["v"]).orderBy("rank").collect()]
    assert edges == [(1, 0.0, 4), (2, 3.0, 4), (3, 9.0, 1)]


def test_leading_bins_stop_at_the_number_of_bins(spark):
    df = frame(spark, [0, 1, 2, 3])  # 2 bins and the extra one, all in use
    assert ranks.histogram_edges(df, ["v"]).count() == 2
    assert ranks.bin_counts(df, ["v"]).count() == 3


def test_counts_add_up_to_the_rows(spark, numbers):
    totals = ranks.histogram(numbers, ["plain", "whole", "hot"]).groupBy("column").sum("count").collect()
    assert {r[1] for r in totals} == {200}


def scans(monkeypatch, df, **options):
    """The median and how many scans it took."""
    made, real = [], ranks.narrowing_scan
    monkeypatch.setattr(ranks, "narrowing_scan", lambda *a: made.append(1) or real(*a))
    return ranks.median(df, ["v"], **options).first().median, len(made)


@pytest.mark.parametrize("order", ["sorted", "mixed"])
def test_one_scan_more_than_intervals(spark, monkeypatch, order):
    # However rows are dealt: in order, so that every task has values of its own, or mixed.
    df = spark.range(0, 40_000, 1, 8).selectExpr("double(id) + 1 AS v" if order == "sorted" else "double(pmod(id * 7919, 40000)) + 1 AS v")
    assert scans(monkeypatch, df, limit=40_000) == (20_001.0, 1)
    assert scans(monkeypatch, df, limit=1_000) == (20_001.0, 2)


def test_intervals_shrink_by_hundreds_a_scan(spark, monkeypatch):
    monkeypatch.setattr(ranks, "EXACT_LIMIT", 100)
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("sqrt(double(pmod(id * 7919, 1000000))) AS v")
    assert scans(monkeypatch, df, limit=100) == (500_000.0**0.5, 3)


def test_a_value_in_most_rows_ends_the_search(spark, monkeypatch):
    df = spark.range(0, 100_000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN double(id) ELSE 7.5D END AS v")
    assert scans(monkeypatch, df, limit=10) == (7.5, 2)


def test_missing_and_infinite_values_count_as_zero(spark):
    values = [None, None, float("nan"), float("inf"), 1.0, 2.0, -3.0, 5.0, 6.0]
    df = spark.createDataFrame([(v, None if v is None else str(v)) for v in values], "v double, t string").repartition(3)
    for limit in (1, 3, 100):
        found = ranks.median(df, ["v", "t"], limit=limit).collect()
        assert {r["column"]: r.median for r in found} == {"v": 0.0, "t": 0.0}


def test_sketches_are_merged_by_group(spark):
    df = spark.range(0, 50_000, 1, 16).selectExpr("double(id) + 1 AS v")
    search = {"v": ranks._Search(25_000, 50_000, held=50_000)}
    plan = ranks.narrowing_scan(df, search, 1_000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__group" in plan and "SinglePartition" not in plan
    rows = ranks.narrowing_scan(df, search, 1_000).collect()
    assert len(rows) == 1 and len(rows[0].sketches) == 16


def test_counted_intervals_reach_the_scan(spark, folder):
    path = f"{folder}/v"
    spark.range(1000).selectExpr("double(id) + 1 AS v").write.parquet(path)
    search = {"v": ranks._Search(500, 300, 350, 350.0, 651.0, held=300)}
    plan = ranks.narrowing_scan(spark.read.parquet(path), search, 1_000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,350.0)" in plan and "LessThan(v,651.0)" in plan
    assert ranks.narrowing_scan(spark.read.parquet(path), search, 1_000).first().value == 500.0


def test_bins_beyond_a_slice_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE", 16)
    df = spark.range(0, 40_000, 1, 6).selectExpr("double(pmod(id * 7919, 40000)) AS a", "double(id % 3) AS b")
    found = {(r["column"], r.bin): r["count"] for r in ranks.bin_counts(df, ["a", "b"]).collect()}
    assert len(found) == 204 and sum(found.values()) == 80_000
    width, extra = 39_999 / 200, {"b": {0: 13_334, 100: 13_333, 200: 13_333}}
    for b in range(201):
        assert found["a", b] == sum(1 for v in range(40_000) if int(v / width) == b)
    assert {k[1]: v for k, v in found.items() if k[0] == "b"} == extra["b"]
