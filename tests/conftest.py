import datetime as dt
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from seriesward import schema as S  # noqa: E402

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def metric_rows(values, host="h", metric_type="cpu_usage", step=10, first=0):
    return [
        (f"{host}-{metric_type}-{first + i:07d}", metric_type, float(v), START + dt.timedelta(seconds=step * (first + i)), host, "test", {})
        for i, v in enumerate(values)
    ]


@pytest.fixture
def metrics(spark):
    """Builds a metrics DataFrame of one or more series."""

    def build(*series):
        rows = [r for s in series for r in (metric_rows(**s) if isinstance(s, dict) else metric_rows(s))]
        return spark.createDataFrame(rows, S.METRIC)

    return build
