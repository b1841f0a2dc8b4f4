from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from terrazzo.session import session

    s = session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(df) -> list[tuple]:
    """Rows as comparable tuples, columns by name, floats rounded, nulls and NaN alike."""
    import pandas as pd

    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return (0, "")
        if isinstance(v, bool):
            return (1, float(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiub":
            return (1, round(float(v), 6) + 0.0)
        return (2, str(v))

    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
