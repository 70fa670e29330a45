import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def rows_of(frame):
    """Rows of a pandas frame as sorted texts, columns by name, numbers to nine places.

    Whole numbers count as integers: pandas holds an integer column with nulls as floats or not, as its source likes.
    """
    import numpy as np
    import pandas as pd

    def plain(x):
        if isinstance(x, (list, np.ndarray)):
            return [plain(v) for v in x]
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer)):
            return int(x)
        if isinstance(x, (float, np.floating)):
            x = round(float(x), 9) + 0.0
            return int(x) if x.is_integer() else x
        return str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(x) for x in row]) for row in frame.values.tolist())
