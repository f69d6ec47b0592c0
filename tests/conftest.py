import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk():
    """Random-walk bars of three symbols; the first has most of the rows."""
    rng = np.random.default_rng(7)
    parts = []
    for symbol, n in (("HOT", 700), ("MID", 230), ("TINY", 9)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.012, n)))
        opened = close * (1 + rng.normal(0, 0.004, n))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "ts": pd.date_range("2021-01-01", periods=n, freq="D"),
                    "open": opened,
                    "high": np.maximum(opened, close) * (1 + rng.uniform(0, 0.006, n)),
                    "low": np.minimum(opened, close) * (1 - rng.uniform(0, 0.006, n)),
                    "close": close,
                    "volume": rng.integers(100, 1000, n).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    from tickloom.plans.series import index_series
    from tickloom.plans.storage import cut

    return cut(index_series(spark.createDataFrame(walk)))


def collect(df, *order):
    return df.toPandas().sort_values(list(order) or ["symbol", "ts"], ignore_index=True)


@pytest.fixture(scope="session")
def sorted_rows():
    return collect
