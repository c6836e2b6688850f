import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("barline-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from closes: make_bars({"A": [1.0, 2.0]}, step=1, volume=10.0)."""
    import pandas as pd

    def build(series, step=1, volume=10.0, start=date(2015, 1, 1)):
        rows = []
        for symbol, closes in series.items():
            for i, c in enumerate(map(float, closes)):
                rows.append((symbol, start + timedelta(days=i * step), c - 0.5, c + 1.0, c - 1.0, c, volume))
        schema = "symbol string, date date, open double, high double, low double, close double, volume double"
        if len(rows) > 500:
            frame = pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"])
            frame["volume"] = frame["volume"].astype("float64")
            return spark.createDataFrame(frame).selectExpr(
                "symbol", "date", "open", "high", "low", "close", "nullif(volume, double('NaN')) AS volume")
        return spark.createDataFrame(rows, schema)

    return build
