import pytest

from ashlar.operators import outliers, ranks
from ashlar.operators.profile import fit

COLUMNS = ["plain", "whole", "hot", "word"]


def brute(rows, stats, centres, interval, feature, low, high):
    hits = []
    for row in rows:
        for c in ("plain", "whole", "hot"):
            s, v = stats[c], float(row[c])
            if interval == "INLIER":
                span = s.max - s.min
                lo, hi = s.min + low * span, s.min + high * span
                if lo < v < hi:
                    hits.append((row.id, c, (v - s.min) / span))
            elif feature == "NONE":
                continue  # nothing lies outside minimum and maximum
            else:
                lo, hi = centres[c] + low * s.stddev, centres[c] + high * s.stddev
                if v < lo or v > hi:
                    hits.append((row.id, c, (v - centres[c]) / s.stddev))
    return hits


@pytest.mark.parametrize(
    "interval, feature, low, high",
    [
        ("inlier", "none", 0.4, 0.6),
        ("Outlier", "Zero", -1, 2),
        ("OUTLIER", "MEAN", -1, 1),
        ("OUTLIER", "MEDIAN", -1, 1),
        ("OUTLIER", "MODE", -1, 1.5),
        ("OUTLIER", "NONE", -3, 3),
    ],
)
def test_scan_finds_every_hit(spark, numbers, interval, feature, low, high):
    stats = fit(numbers, ["plain", "whole", "hot"])
    names = list(stats)
    centres = {
        "ZERO": {c: 0.0 for c in names},
        "MEAN": {c: stats[c].mean for c in names},
        "MEDIAN": {r[0]: r[1] for r in ranks.median(numbers, names).collect()},
        "MODE": {r[0]: r[1] for r in ranks.mode(numbers, names).collect()},
    }.get(feature.upper())
    found = outliers.scan(numbers, "id", names, interval, feature, low, high, stats=stats).collect()
    expected = brute(numbers.collect(), stats, centres, interval.upper(), feature.upper(), low, high)
    assert sorted((r.id, r["column"]) for r in found) == sorted(e[:2] for e in expected)
    deviations = {e[:2]: e[2] for e in expected}
    for r in found:
        assert r.deviation == pytest.approx(deviations[r.id, r["column"]])


def test_orders(spark, numbers):
    by_row = [(r.id, r.col_idx) for r in outliers.scan(numbers, "id", COLUMNS, low=-1, high=1).collect()]
    by_column = [
        (r.col_idx, r.id) for r in outliers.scan(numbers, "id", COLUMNS, low=-1, high=1, order="column").collect()
    ]
    assert by_row == sorted(by_row) and by_column == sorted(by_column)
    assert sorted(by_row) == sorted((i, c) for c, i in by_column)
    with pytest.raises(ValueError):
        outliers.scan(numbers, "id", COLUMNS, order="diagonal")


def test_options_fall_back_with_a_warning():
    with pytest.warns(UserWarning):
        assert outliers.check_options("sideways", "mean", 0.1, 0.2)[0] == "INLIER"
    with pytest.warns(UserWarning):
        assert outliers.check_options("outlier", "average", -1, 1)[1] == "MEAN"
    with pytest.warns(UserWarning):
        assert outliers.check_options("inlier", "mean", 3, 1)[2:] == (0.2, 0.8)
    with pytest.warns(UserWarning):
        assert outliers.check_options("outlier", "mean", 3, 1)[2:] == (-3.0, 3.0)


def test_bounds_reach_the_parquet_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = outliers.scan(events, "event_id", ["value"], feature="MEAN", order=None)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(value" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_null_counts_as_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 10.5), (3, 11.5), (4, 12.5), (5, 11.0)], "id int, v double")
    found = outliers.scan(df, "id", ["v"], feature="MEAN", low=-1, high=1).collect()
    assert [(r.id, r.value) for r in found] == [(1, 0.0)]
