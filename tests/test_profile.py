import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ashlar.operators import profile as P

COLUMNS = ["plain", "whole", "constant", "zero", "hot", "word", "text"]


def test_agrees_with_the_ml_summarizer(spark, numbers):
    cols = ["plain", "whole", "constant", "zero", "hot"]
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(numbers)
    names = ["mean", "variance", "count", "max", "min", "normL1", "normL2", "numNonZeros"]
    reference = vectors.select(Summarizer.metrics(*names).summary(F.col("v")).alias("s")).first().s
    stats = P.fit(numbers, cols)
    for i, c in enumerate(cols):
        s = stats[c]
        mine = [s.mean, s.variance, s.count, s.max, s.min, s.l1, s.l2, s.nonzeros]
        theirs = [reference["count"] if n == "count" else reference[n][i] for n in names]
        assert mine == pytest.approx(theirs, rel=1e-12), c
        assert s.stddev == pytest.approx(math.sqrt(s.variance))


def test_moments_follow_their_definition(spark, numbers):
    values = [r[0] for r in numbers.select("plain").collect()]
    n = len(values)
    mean = sum(values) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    s = P.fit(numbers, ["plain"], moments=True)["plain"]
    assert s.skewness == pytest.approx(sum(((v - mean) / sd) ** 3 for v in values) / n)
    assert s.kurtosis == pytest.approx(sum(((v - mean) / sd) ** 4 for v in values) / n - 3)
    raw = P.raw_moments(numbers, ["plain"]).first()
    assert raw.raw_moment3 == pytest.approx(sum(v**3 for v in values) / n)
    assert raw.raw_moment4_minus3 == pytest.approx(sum(v**4 for v in values) / n - 3)


@pytest.mark.parametrize("moments", [False, True])
def test_long_form_equals_wide_form(spark, numbers, monkeypatch, moments):
    monkeypatch.setattr(P, "STAGE_FIELDS", 10_000)
    wide = P.profile(numbers, COLUMNS, moments).orderBy("col_idx").toPandas()
    monkeypatch.setattr(P, "STAGE_FIELDS", 0)
    long = P.profile(numbers, COLUMNS, moments).orderBy("col_idx").toPandas()
    assert list(wide.columns) == list(long.columns)
    for c in wide.columns:
        assert list(wide[c])[:3] == pytest.approx(list(long[c])[:3], nan_ok=True), c
        if wide[c].dtype == object:
            assert list(wide[c]) == list(long[c])


def test_types(spark, numbers):
    types = {r["column"]: r.inferred_type for r in P.infer_types(numbers, COLUMNS).collect()}
    assert types == {
        "plain": "Double",
        "whole": "Int",
        "constant": "Double",
        "zero": "String",  # indistinguishable from text, as parse_rate tells
        "hot": "Double",
        "word": "String",
        "text": "Double",
    }
    rates = {r["column"]: r.parse_rate for r in P.infer_types(numbers, COLUMNS).collect()}
    assert rates["zero"] == 1.0 and rates["word"] == 0.0 and rates["text"] == 1.0


def test_coarse_rule_can_be_fooled_and_exact_rule_not(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (2.0,), (0.0,)], "v double")
    assert P.infer_types(df, ["v"], "coarse").first().inferred_type == "Int"
    assert P.infer_types(df, ["v"], "exact").first().inferred_type == "Double"
    with pytest.raises(ValueError):
        P.infer_types(df, ["v"], "other")


def test_numeric_labels(spark):
    df = spark.range(100).select(
        (F.col("id") + 20000).alias("large"),
        (F.col("id") % 2).alias("two_valued"),
        F.when(F.col("id") == 0, -1).otherwise(20000).alias("negative"),
        F.expr("int(rint(10 + 3 * sqrt(-2 * ln((id + 1) / 101)) * cos(id)))").alias("bell"),
    )
    types = {r["column"]: r.inferred_type for r in P.infer_types(df, df.columns, "label").collect()}
    assert types == {"large": "NumLabel", "two_valued": "NumLabel", "negative": "Int", "bell": "Int"}


def test_edge_tables(spark):
    one = P.fit(spark.createDataFrame([(2.5,)], "v double"), ["v"], moments=True)["v"]
    assert (one.count, one.mean, one.variance, one.stddev) == (1, 2.5, 0.0, 0.0)
    empty = spark.createDataFrame([], "v double, w string")
    assert P.profile(empty).count() == 0
    nulls = P.fit(spark.createDataFrame([(None,), (4.0,)], "v double"))["v"]
    assert (nulls.count, nulls.parsed, nulls.mean, nulls.nonzeros) == (2, 1, 2.0, 1)
    times = spark.sql("SELECT timestamp'2020-01-01' AS t, date'2020-01-01' AS d, true AS b")
    assert {s.inferred_type for s in P.fit(times).values()} == {"String"}


def test_not_finite_numbers_are_missing(spark):
    df = spark.sql("SELECT explode(array(double('NaN'), double('Infinity'), -double('Infinity'), 4D, NULL)) AS v")
    found = P.fit(df.selectExpr("v", "float(v) AS f"), moments=True)
    for s in found.values():
        assert (s.count, s.parsed, s.mean, s.min, s.max, s.inferred_type) == (5, 1, 0.8, 0.0, 4.0, "Int")
    assert P.fit(df.filter("isnan(v)"))["v"].inferred_type == "String"


def test_least_parse_rate_keeps_words_as_text(spark):
    df = spark.createDataFrame([("7",), ("Bob",), ("Eve",), ("Nan",)], "w string")
    assert P.fit(df)["w"].inferred_type == "Int"
    assert P.fit(df, least_parse_rate=0.25)["w"].inferred_type == "Int"
    assert P.fit(df, least_parse_rate=0.3)["w"].inferred_type == "String"


def test_only_named_columns_are_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = P.profile(df, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan


@pytest.mark.parametrize("width", [1, 4, 5, 30])
def test_moments_of_an_empty_table(spark, width):
    empty = spark.range(0).selectExpr(*[f"double(id) AS c{i}" for i in range(width)])
    assert P.profile(empty, moments=True).count() == 0
