"""Layout along a curve, and scans by ranges of files."""

from datetime import timedelta

import pytest
from conftest import at, files_read
from pyspark.sql import functions as F

from changetide.sources import curve, files

COLUMNS = ("record", "time")


@pytest.fixture
def laid_out(spark, tmp_path):
    # one record holds a third of the rows
    rows = [(i, f"r{0 if i % 3 == 0 else i * 7919 % 300:03}" if i % 50 else None, at(i * 60)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, record string, time timestamp")
    curve.write_table(df, str(tmp_path / "t"), "time", COLUMNS, files=32)
    stored = files.read_table(spark, str(tmp_path / "t"))
    return rows, stored, curve.ranges_by_file(stored, COLUMNS).persist()


def test_both_ways_leave_files_out(spark, laid_out):
    rows, stored, ranges = laid_out
    every = files_read(spark, stored)
    bounds = [{"record": ("r123", "r123")}, {"time": (at(60_000), at(70_000))}, {"record": ("r200", None), "time": (None, at(60_000))}]
    for asked in bounds:
        found = curve.between(stored, ranges, **asked)

        def holds(row):
            values = {"record": row[1], "time": row[2]}
            return all(
                values[c] is not None and (low is None or values[c] >= low) and (high is None or values[c] <= high)
                for c, (low, high) in asked.items()
            )

        assert sorted(r.id for r in found.collect()) == [r[0] for r in rows if holds(r)]
        assert files_read(spark, found) <= every / 2
        assert curve.between(stored, ranges, max_files=1, **asked).count() == found.count()


def test_hot_record_is_split(laid_out):
    _, stored, _ = laid_out
    sizes = [r["count"] for r in stored.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(sizes) <= 6000 / 32 * 4


def test_unknown_files_are_read(spark, laid_out, tmp_path):
    _, _, ranges = laid_out
    ranges.count()
    more = spark.createDataFrame([(9999, "r123", at(0) + timedelta(days=90))], "id int, record string, time timestamp")
    curve.write_table(more, str(tmp_path / "t"), "time", COLUMNS)
    stored = files.read_table(spark, str(tmp_path / "t"))
    assert curve.between(stored, ranges, record=("r123", "r123")).where("id = 9999").count() == 1


def test_empty_and_null(spark, tmp_path):
    df = spark.createDataFrame([(1, None, at()), (2, None, None)], "id int, record string, time timestamp")
    assert curve.cuts(df.where("id > 2"), COLUMNS) == {"record": [], "time": []}
    curve.write_table(df, str(tmp_path / "n"), "time", COLUMNS)
    stored = files.read_table(spark, str(tmp_path / "n"))
    assert stored.count() == 2
    assert curve.between(stored, curve.ranges_by_file(stored, COLUMNS), record=("a", None)).count() == 0
