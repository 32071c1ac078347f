import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from sealbook.operators.validate import valid_deliveries  # noqa: E402
from sealbook.session import local_session  # noqa: E402

NOW = 1_750_000_100_000
BASE = 1_750_000_000_000


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def deliver(spark):
    """Deliveries from (event_id, quantity, event_time_ms) rows, in list order."""

    def make(rows, customer="c1", metric="api_calls"):
        full = [(i, customer, metric, str(q), t, t, None, n) for n, (i, q, t) in enumerate(rows)]
        df = spark.createDataFrame(
            full,
            "event_id string, customer_id string, metric string, quantity string, "
            "event_time_ms long, ingest_time_ms long, payload string, arrival long",
        )
        return valid_deliveries(df, NOW)

    return make


@pytest.fixture
def as_map():
    def read(df, key, value):
        return {r[key]: r[value] for r in df.select(F.col(key), F.col(value)).collect()}

    return read
