import json
import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changetide import schemas  # noqa: E402
from changetide.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds=0):
    return datetime.fromtimestamp(1_700_000_000 + seconds, tz=timezone.utc)


def files_read(spark, frame):
    """How many files a scan is planned for."""
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    try:
        return frame.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


@pytest.fixture
def landed(spark):
    """Make broker messages from (topic, partition, offset, document) rows."""

    def make(rows, stamp=None):
        texts = [
            (t, p, o, stamp or at(o or 0), v if isinstance(v, (str, bytes)) or v is None else json.dumps(v))
            for t, p, o, v in rows
        ]
        binary = [(*r[:4], r[4].encode() if isinstance(r[4], str) else r[4]) for r in texts]
        return spark.createDataFrame(binary, schemas.MESSAGE)

    return make


def flat(op, before=None, after=None, ts_ms=1_696_932_610_000, table="orders", **source):
    return {
        "before": before,
        "after": after,
        "source": {"name": "orderdb", "db": "shop", "schema": "public", "table": table, **source},
        "op": op,
        "ts_ms": ts_ms,
    }
