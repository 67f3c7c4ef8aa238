"""Substring search with grams by file."""

import pytest
from conftest import files_read
from pyspark.sql import functions as F

from changetide.operators import search, substring

TEXTS = [
    ("Copper wire from Antwerp", 0),
    ("copper and TIN", 0),
    (None, 0),
    ("", 0),
    ("ÄRMEL 100% wool_blend", 1),
    ("a long walk \U0001f6b2\U0001f6b2\U0001f6b2 home" + " and on" * 5000, 1),
    (None, 2),
]


@pytest.fixture
def table(spark, tmp_path):
    def put(rows):
        frame = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], "id int, raw_payload string, f int")
        for f in sorted({f for _, f in rows}):
            frame.where(F.col("f") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        return spark.read.parquet(str(tmp_path / "t"))

    return put


@pytest.mark.parametrize(
    "term, escape, read",
    [
        ("COPPER", False, 1),
        ("ärm", False, 1),
        ("100%", True, 1),
        ("wool_bl", True, 1),
        ("cop_er%ant", False, 1),
        ("\U0001f6b2\U0001f6b2\U0001f6b2", False, 1),
        ("nowhere to be seen", False, 0),
        ("co", False, 3),
        ("", False, 3),
        ("%", True, 3),
    ],
)
def test_equal_to_the_full_scan(spark, table, term, escape, read):
    stored = table(TEXTS)
    grams = substring.grams_by_file(stored)
    found = substring.search_stored(stored, grams, term, escape=escape)
    wanted = stored.where(F.col("raw_payload").ilike(search.like_pattern(term, escape)))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in wanted.collect())
    assert files_read(spark, found) == read


def test_new_files_are_read_until_indexed(spark, table, tmp_path):
    at = str(tmp_path / "grams")
    substring.grams_by_file(table(TEXTS)).write.parquet(at)
    stored = table([("copper again", 0)])
    found = substring.search_stored(stored, spark.read.parquet(at), "copper a")
    assert sorted(r.raw_payload for r in found.collect()) == ["copper again", "copper and TIN"]
    for most in (100_000, 1):
        assert [r.raw_payload for r in substring.not_indexed(stored, spark.read.parquet(at), most).collect()] == ["copper again"]
    new = substring.not_indexed(stored, spark.read.parquet(at))
    substring.grams_by_file(new).write.mode("append").parquet(at)
    assert spark.read.parquet(at).where("bucket = 0").count() == 4
    assert files_read(spark, substring.search_stored(stored, spark.read.parquet(at), "wool")) == 1
    # fewer paths in the filter, the same rows
    assert substring.search_stored(stored, spark.read.parquet(at), "wool", max_files=1).count() == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "id int, raw_payload string").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert substring.search_stored(stored, substring.grams_by_file(stored), "copper").count() == 0


def test_literal_runs():
    assert substring.literal_runs(r"%a\%b_cd%") == ["a%b", "cd"]
    assert substring.literal_runs(r"%\\x%") == ["\\x"]
