import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ashlar.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="run-")
    return local_session("tests", 4, **{"spark.checkpoint.dir": shared, "spark.default.parallelism": "4"})


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def numbers(spark):
    """Columns that bring out every special case, in several partitions."""
    rows = []
    for i in range(200):
        rows.append(
            (
                i,
                float((i * 37) % 101) / 7,  # plain doubles
                i % 5,  # whole numbers with ties
                4.25,  # constant
                0.0,  # all zero
                7.5 if i % 3 == 0 else float(i) ** 2 / 100,  # one value holds a third
                f"word {i}",
                str(i / 4),  # numbers as text
            )
        )
    schema = "id long, plain double, whole int, constant double, zero double, hot double, word string, text string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()
