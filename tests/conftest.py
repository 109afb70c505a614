import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast import schema as s  # noqa: E402
from shelfcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "shelfcast-tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_sales(spark):
    """Sales from (region, store, product, 'yyyy-mm-dd[ hh:mm]', quantity[, mrp, discount]) tuples."""

    def build(rows):
        full = []
        for region, store, product, when, quantity, *rest in rows:
            mrp, discount = (list(rest) + [100.0, 0.0][len(rest) :])[:2]
            stamp = None if when is None else datetime.datetime.fromisoformat(when)
            full.append((region, store, product, stamp, quantity, mrp, discount, None, None, None, None))
        return spark.createDataFrame(full, s.SALES_SCHEMA)

    return build
