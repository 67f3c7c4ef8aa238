"""Substring search over stored tables that reads only files which may hold the term.

For every file of a stored table a few bitmaps tell which grams (three characters in a row, lower-cased)
occur in a text column; a gram has one of `BITS` places by its hash. A term can only be found in files
that hold all its grams, so the scan leaves the others out and the usual `ilike` decides over what is
read. Files written after the bitmaps are read in any case, so a table may grow between two updates.

Null texts have no grams. Files are known by their path, which Spark never uses twice. A term without
three literal characters in a row rules nothing out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.operators.search import like_pattern

WIDTH = 3
BITS = 1 << 18
FILE = "_metadata.file_path"


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)) + 1


def grams_by_file(stored: DataFrame, column: str = "raw_payload") -> DataFrame:
    """(file, bucket, bits) of every file of a stored table; each file has a row with bucket 0 and no bits.

    Grams become distinct in the tasks that read them, so what is shuffled is bounded by the number of
    places for each file and task."""
    # a look-ahead takes every window in one pass, whatever the length of the text
    windows = F.regexp_extract_all(F.lower(F.col(column)), F.lit(f"(?s)(?=({'.' * WIDTH}))"), F.lit(1))
    texts = stored.select(F.col(FILE).alias("file"), F.array_distinct(windows).alias("grams"))
    # the place 0 stands for the file itself
    places = texts.select("file", F.explode_outer("grams").alias("gram"))
    places = places.select("file", F.explode(F.array(F.lit(0).cast("long"), _place(F.col("gram")))).alias("place"))
    places = places.where("place IS NOT NULL").distinct()
    bits = F.bitmap_construct_agg(F.when(F.col("place") > 0, F.bitmap_bit_position("place")))
    found = places.groupBy("file", F.bitmap_bucket_number("place").alias("bucket")).agg(bits.alias("bits"))
    return found.withColumn("bits", F.when(F.col("bucket") > 0, F.col("bits")))


def not_indexed(stored: DataFrame, grams: DataFrame, max_files: int = 100_000) -> DataFrame:
    """The rows of files that have no bitmaps yet; append their `grams_by_file` to bring the bitmaps up to date.

    Known files are left out of the scan, up to `max_files`; the rows of further ones go by an anti-join."""
    known = grams.where("bucket = 0").select("file").distinct()
    rest = left_out(stored, known, max_files)
    if known.count() <= max_files:
        return rest
    return rest.withColumn("__file", F.col(FILE)).join(known, F.col("__file") == known["file"], "left_anti").drop("__file")


def left_out(stored: DataFrame, files: DataFrame, max_files: int) -> DataFrame:
    """The table without (file) files, at most `max_files` of them; Spark drops them when it plans the scan."""
    paths = [r["file"] for r in files.orderBy("file").limit(max_files).collect()]
    return stored.where(~F.col(FILE).isin(paths)) if paths else stored


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern asks for literally, between its wildcards."""
    runs, escaped = [""], False
    for char in pattern:
        if escaped or char not in "\\%_":
            runs[-1] += char
            escaped = False
        elif char == "\\":
            escaped = True
        else:
            runs.append("")
    return [r for r in runs if r]


def ruled_out(grams: DataFrame, pattern: str) -> DataFrame:
    """(file) of the files in which no text can match a LIKE pattern, case ignored."""
    spark = grams.sparkSession
    low = spark.sql("SELECT lower(:p) AS p", {"p": pattern}).first()["p"]  # as ilike lowers it
    asked = sorted({run[i : i + WIDTH] for run in literal_runs(low) for i in range(len(run) - WIDTH + 1)})
    if not asked:
        return grams.select("file").limit(0)
    place = _place(F.col("gram"))
    # as many rows as the term has grams
    wanted = spark.createDataFrame([(g,) for g in asked], "gram string").select(place.alias("place")).distinct()
    wanted = wanted.select(
        F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit")
    )
    total = wanted.count()
    rows = grams.where(F.col("bucket").isin(0, *(r["bucket"] for r in wanted.select("bucket").distinct().collect())))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(byte, cast(bit % 8 as int)) & 1")
    rows = rows.join(wanted, "bucket", "left").withColumn("byte", byte).withColumn("held", held)
    return rows.groupBy("file").agg(F.sum("held").alias("n")).where(F.coalesce("n", F.lit(0)) < total).select("file")


def search_stored(
    stored: DataFrame,
    grams: DataFrame,
    term: str,
    *,
    column: str = "raw_payload",
    escape: bool = False,
    max_files: int = 100_000,
) -> DataFrame:
    """The rows of a stored table whose text holds a term, as `search_events` finds them.

    The paths of up to `max_files` ruled-out files go into the scan's filter; files beyond that are read
    like those that may hold the term, so the result is the same."""
    pattern = like_pattern(term, escape)
    return left_out(stored, ruled_out(grams, pattern), max_files).where(F.col(column).ilike(pattern))
