import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodestone.runtime import session, ship

    s = session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con

