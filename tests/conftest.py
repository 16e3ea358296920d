import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradeloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Results of a column function on rows of texts, in row order."""

    def run(function, rows, columns=("a",)):
        from pyspark.sql import functions as F

        wrapped = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        schema = "_row int, " + ", ".join(f"{c} string" for c in columns)
        df = spark.createDataFrame(wrapped, schema)
        out = df.select("_row", function(*[F.col(c) for c in columns]).alias("out"))
        return [r.out for r in sorted(out.collect(), key=lambda r: r._row)]

    return run
