import pytest

from ashlar import session
from ashlar.operators import distribution, ranks, relate
from ashlar.sources.tables import read_table, staged


class Conf:
    def __init__(self, value, master="local[2]"):
        self.value, self.conf, self.sparkContext, self.master = value, self, self, master

    def get(self, key, default):
        return self.value or default


def test_shared_folder_comes_from_the_session():
    path = session.shared_path(Conf("/shared/x/"), "rows")
    assert path.startswith("/shared/x/rows-") and path != session.shared_path(Conf("/shared/x/"), "rows")


def test_machine_local_folder_only_in_local_mode():
    assert "ashlar-" in session.shared_path(Conf(None), "rows")
    with pytest.raises(ValueError):
        session.shared_path(Conf(None, "spark://host:7077"), "rows")


def test_staged_rows_are_columns(spark, numbers):
    again = staged(numbers, "numbers")
    assert again.count() == 200 and again.dtypes == numbers.dtypes
    assert "Scan parquet" in again._jdf.queryExecution().executedPlan().toString() or "FileScan parquet" in again._jdf.queryExecution().executedPlan().toString()


def test_reading_a_table_shuffles_nothing(spark):
    plain = read_table(spark, "/root/testdata/sf0.001/orders.parquet")
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_text_only_tables_are_refused_by_numeric_operators(numbers):
    words = numbers.select("word")
    for operator in (ranks.median, ranks.histogram, ranks.mode, distribution.kde, distribution.ks_normal):
        with pytest.raises(ValueError):
            operator(words)
    with pytest.raises(ValueError):
        relate.chi2_gof(words, ["word"])
