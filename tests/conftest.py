from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.fixture
def sf_dir():
    return DATA


def _family(dtype) -> str:
    return {"u": "i", "i": "i", "f": "f", "b": "b"}.get(getattr(dtype, "kind", "O"), "O")


def same(spark_rows, duck_rows) -> None:
    """Equal columns, kinds of types and rows, in any order; a null equals a null alone."""
    columns = sorted(spark_rows.columns)
    assert columns == sorted(duck_rows.columns)
    assert len(spark_rows) == len(duck_rows)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (spark_rows, duck_rows))
    for c in columns:
        nulls, others = a[c].isna().to_numpy(), b[c].isna().to_numpy()
        assert (nulls == others).all(), (c, a[c][nulls != others].head(3).tolist(), b[c][nulls != others].head(3).tolist())
        if len(a) and not nulls.any():
            assert _family(a[c].dtype) == _family(b[c].dtype), (c, a[c].dtype, b[c].dtype)
        x, y = a[c][~nulls].tolist(), b[c][~nulls].tolist()
        assert x == y, (c, [p for p in zip(x, y, strict=True) if p[0] != p[1]][:3])
