import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nasty import CLASHES, nasty_rows  # noqa: E402


@pytest.fixture(scope="session")
def nasty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows(), "doc_id long, text string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "s0"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1.5) for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.limit(0)
