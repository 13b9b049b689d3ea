"""Results do not depend on how the rows are partitioned."""

import pytest

from ashlar.operators import clean, distribution, normalize, outliers, ranks, relate
from ashlar.operators.profile import profile

COLUMNS = ["plain", "whole", "hot"]
OPERATORS = {
    "profile": lambda df: profile(df, COLUMNS, moments=True),
    "correlation": lambda df: relate.correlation(df, COLUMNS),
    "independence": lambda df: relate.chi2_independence(df, COLUMNS, p_value=False),
    "goodness": lambda df: relate.chi2_gof(df, COLUMNS, p_value=False),
    "normality": lambda df: distribution.ks_normal(df, COLUMNS, p_value=False, buckets=64),
    "density": lambda df: distribution.kde(df, COLUMNS),
    "median": lambda df: ranks.median(df, COLUMNS, limit=10),
    "histogram": lambda df: ranks.histogram(df, COLUMNS),
    "ranked_modes": lambda df: ranks.ranked_modes(df, COLUMNS),
    "mode": lambda df: ranks.mode(df, COLUMNS),
    "row_norms": lambda df: normalize.row_norms(df, ["id"], COLUMNS),
    "extreme_rows": lambda df: normalize.extreme_rows(normalize.row_norms(df, ["id"], COLUMNS), "id", ["row_max", "zeros"]),
    "scan": lambda df: outliers.scan(df, "id", COLUMNS, low=-1, high=1),
    "shape": lambda df: clean.field_shape(df.selectExpr("id AS row_id", "concat(word, ',', repeat('x,', whole)) AS value")),
    "counts": lambda df: clean.stage_counts(df.selectExpr("id AS row_id", "concat(word, ',', repeat('x,', whole)) AS value")),
}


def rounded(rows):
    return sorted(repr([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_same_result_at_any_partitioning(numbers, name):
    results = [rounded(OPERATORS[name](numbers.repartition(n)).collect()) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]
