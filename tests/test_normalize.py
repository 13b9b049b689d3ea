import math

import pytest

from ashlar.operators import normalize as N
from ashlar.operators.profile import ColumnStats, fit


def test_zscores_have_mean_zero_and_variance_one(spark, numbers):
    scaled = N.zscore(numbers, ["plain", "hot"])
    assert scaled.columns == numbers.columns
    stats = fit(scaled, ["plain", "hot"])
    for s in stats.values():
        assert s.mean == pytest.approx(0, abs=1e-12) and s.variance == pytest.approx(1)
    # Everything else is passed through.
    assert sorted(r.word for r in scaled.collect()) == sorted(r.word for r in numbers.collect())


def test_constant_column_has_no_zscore(spark, numbers):
    assert {r.constant for r in N.zscore(numbers, ["constant"]).collect()} == {None}


def test_labels_and_text_pass_through(spark):
    df = spark.range(20000, 20100).selectExpr("id AS label", "concat('w', id) AS word", "id / 7D AS v")
    scaled = N.zscore(df)
    assert scaled.first().label >= 20000 and dict(scaled.dtypes)["label"] == "bigint"


def stats_of(mean, sd, name, idx):
    return ColumnStats(name, idx, 3, 3, mean, sd * sd, sd, 0.0, 1.0, 1.0, 1.0, 3, False, "Double")


def test_row_norms_follow_the_definition(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, -4.0), (3, 500.0, 0.0)], "k int, a double, b double")
    stats = {"a": stats_of(1.0, 2.0, "a", 0), "b": stats_of(0.0, 1.0, "b", 1)}
    rows = {r.k: r for r in N.row_norms(df, ["k"], stats=stats).collect()}
    assert (rows[1].row_max, rows[1].row_min, rows[1].zeros) == (2.0, 0.0, 1)
    assert (rows[2].l1_norm, rows[2].l2_norm) == (5.0, pytest.approx(math.sqrt(1 + 16)))
    # A z-score of 249.5 is beyond the guard: it counts as largest, not in the norms.
    assert (rows[3].row_max, rows[3].l1_norm, rows[3].l2_norm, rows[3].zeros) == (249.5, 0.0, 0.0, 1)


def test_norms_without_any_scaled_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "w string")
    row = N.row_norms(df, ["w"]).first()
    assert (row.row_max, row.row_min, row.zeros, row.l1_norm) == (-999999.0, 999999.0, 0, 0.0)


def test_extreme_rows_break_ties_by_position(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 8 else float(i)) for i in range(12)], "k int, l1_norm double")
    found = N.extreme_rows(df.repartition(4), "k", ["l1_norm"]).collect()
    lists = {
        d: [r.k for r in sorted(found, key=lambda r: r["rank"]) if r.direction == d] for d in ("smallest", "largest")
    }
    assert lists == {"smallest": [0, 1, 2, 3, 4], "largest": [11, 10, 9, 8, 7]}


def test_extreme_rows_take_one_scan(spark, folder):
    spark.range(500).selectExpr("id", "double(id % 7) AS a", "double(id) AS b").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    norms = N.row_norms(df, ["id"], ["a", "b"], stats={"a": stats_of(3.0, 2.0, "a", 0), "b": stats_of(250.0, 144.0, "b", 1)})
    plan = N.extreme_rows(norms, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Sort" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("k", [1, 5, 40, 300])
def test_extreme_rows_equal_sorting(spark, k):
    # Three values only, so that every list is cut among ties; keys are text, one of them NULL.
    rows = [(None if i == 77 else f"k{i * 37 % 250:03d}", float(i % 3), None if i % 11 == 0 else i / 7) for i in range(250)]
    df = spark.createDataFrame(rows, "key string, zeros double, l1_norm double").repartition(5)
    found = N.extreme_rows(df, "key", ["zeros", "l1_norm"], k=k).collect()
    for metric, at in (("zeros", 1), ("l1_norm", 2)):
        for direction, up in (("smallest", False), ("largest", True)):
            order = sorted((r for r in rows if r[at] is not None), key=lambda r: (r[at], r[0] is not None, r[0] or ""), reverse=up)
            mine = sorted((r["rank"], r.key, r.value) for r in found if (r.metric, r.direction) == (metric, direction))
            assert mine == [(n, r[0], r[at]) for n, r in enumerate(order[:k], 1)]


def test_struct_keys_break_ties_field_by_field(spark):
    df = spark.range(60).selectExpr("struct(id % 3 AS a, struct(id AS b) AS c) AS row_id", "1D AS l1_norm").repartition(4)
    found = N.extreme_rows(df, "row_id", ["l1_norm"], k=2).collect()
    keys = {(r.direction, r["rank"]): (r.row_id.a, r.row_id.c.b) for r in found}
    assert keys == {("smallest", 1): (0, 0), ("smallest", 2): (0, 3), ("largest", 1): (2, 59), ("largest", 2): (2, 56)}


def test_one_direction_of_extreme_rows(spark, numbers):
    norms = N.row_norms(numbers, ["id"], ["plain", "hot"])
    assert {r.direction for r in N.extreme_rows(norms, "id", ascending=False).collect()} == {"largest"}
    assert N.extreme_rows(norms.limit(0), "id").count() == 0


def test_labeled_norms_keep_leading_columns(spark, numbers):
    norms = N.labeled_norms(numbers, cols=["plain"])
    assert norms.columns == [*numbers.columns[:6], "l1_norm", "l2_norm"]
    order = [r.l1_norm for r in N.sort_rows(norms, "id", "l1_norm", False).collect()]
    assert order == sorted(order, reverse=True)
