"""Running computations over ordered groups that do not put a whole group into one task.

A plain window sorts each group in a single task. Here a group with more than ``hot_rows`` rows is
cut into slices of about equal size. Slices follow the order, hence:

    result inside the whole group = result inside the slice + what the earlier slices carry in

and the carry is a window over one row per slice. The cuts are a function of the data alone: exact
counts, smallest and largest values, and integer histograms, none of which depends on the order in
which rows arrive. So every use of a cut, and every retried task, cuts alike, and results are exact.

A histogram divides the range of a group into equal buckets; a bucket with more than its share of
rows is divided once more over its own range, so outliers do not spoil the cuts. An order value with
more than ``tie_rows`` rows becomes a slice of its own and is cut further by ranges of the first tie
column, a number. Groups below ``hot_rows`` are one slice and cost one count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

from changetide.session import work_folder

BUCKETS = 4096


@dataclass(frozen=True)
class Slicing:
    """When a group counts as hot and how finely it is cut."""

    hot_rows: int = 5_000_000
    parts: int = 64
    tie_rows: int = 1_000_000


DEFAULT = Slicing()

_SLICE = ("_slice", "_sub")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality between ``key`` and ``prefix + key``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join that keeps the left side's key columns."""
    renamed = right.select(
        *(F.col(k).alias("_r_" + k) if k in keys else F.col(k) for k in right.columns)
    )
    joined = left.join(renamed, same_keys(left, renamed, keys, "_r_"), how)
    return joined.drop(*("_r_" + k for k in keys))


def _number(df: DataFrame, order: str) -> Column:
    """The order column as a double that never falls as the column rises; NaN comes last."""
    kind = df.schema[order].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(order).cast("double")
    return F.col(order).cast("double")


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """Which of BUCKETS equal parts of a range holds x; values outside, infinite or NaN at the ends."""
    share = (x - low) / (high - low)
    inside = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (BUCKETS - 1))
    place = (
        F.when(x.isNull(), -1)
        .when(F.isnan(x) | (x > high), BUCKETS)
        .when((x < low) | (high <= low), 0)
        .otherwise(inside)
    )
    return F.coalesce(place, F.lit(0)).cast("bigint")


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def _hot_groups(df: DataFrame, keys: Sequence[str], slicing: Slicing) -> DataFrame:
    """Groups above the bound with their size and range."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_cut_n"),
            F.min(_finite(F.col("_cut_x"))).alias("_cut_low"),
            F.max(_finite(F.col("_cut_x"))).alias("_cut_high"),
        )
        .where(F.col("_cut_n") > slicing.hot_rows)
    )


def _hot_rows(df: DataFrame, groups: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keys and order of the rows of hot groups, each with its bucket."""
    hot = attach(df.select(*keys, order, "_cut_x"), groups, keys, "inner")
    return hot.withColumn("_cut_b", _bucket(F.col("_cut_x"), F.col("_cut_low"), F.col("_cut_high")))


def _cuts(hot: DataFrame, groups: DataFrame, keys: Sequence[str], order: str, slicing: Slicing) -> DataFrame:
    """One row per hot group: its range, the buckets divided again, the cuts and the heavy values."""
    full = (
        hot.groupBy(*keys, "_cut_b")
        .agg(
            F.count(F.lit(1)).alias("_cut_m"),
            F.first("_cut_n").alias("_cut_n"),
            F.min(_finite(F.col("_cut_x"))).alias("_cut_l"),
            F.max(_finite(F.col("_cut_x"))).alias("_cut_h"),
        )
        .where(F.col("_cut_m") * slicing.parts > F.col("_cut_n"))
    )
    # Fewer than ``parts`` buckets of a group can be full.
    again = full.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_cut_b", F.struct("_cut_l", "_cut_h")))).alias("_cut_again")
    )
    fine = attach(hot, again, keys).withColumn("_cut_fine", _fine(F.col("_cut_x")))
    counts = fine.groupBy(*keys, "_cut_fine").agg(F.count(F.lit(1)).alias("_cut_m"), F.first("_cut_n").alias("_cut_n"))
    upto = F.sum("_cut_m").over(W.partitionBy(*keys).orderBy("_cut_fine")) - F.col("_cut_m")
    part = F.floor(upto * slicing.parts / F.col("_cut_n"))
    starts = (
        counts.withColumn("_cut_part", part)
        .groupBy(*keys, "_cut_part")
        .agg(F.min("_cut_fine").alias("_cut_start"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_cut_start")).alias("_cut_starts"))
    )
    heavy = (
        hot.groupBy(*keys, order)
        .agg(F.count(F.lit(1)).alias("_cut_m"))
        .where(F.col("_cut_m") > slicing.tie_rows)
        .groupBy(*keys)
        .agg(F.collect_list(order).alias("_cut_heavy"))
    )
    plan = groups.drop("_cut_n")
    for more in (again, starts, heavy):
        plan = attach(plan, more, keys)
    return plan


def _fine(x: Column) -> Column:
    """The bucket of x in a group's histogram, with the second digit where a bucket is divided again."""
    bucket = F.col("_cut_b")
    own = F.element_at("_cut_again", bucket)
    return bucket * (BUCKETS + 2) + _bucket(x, own["_cut_l"], own["_cut_h"])


def surely_small(df: DataFrame, slicing: Slicing) -> bool:
    """Does the optimizer expect fewer bytes of an input than a hot group has rows? Then none is hot."""
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return int(size) < slicing.hot_rows


def cut_plan(df: DataFrame, keys: Sequence[str], order: str, slicing: Slicing = DEFAULT) -> DataFrame | None:
    """One stored row per hot group with its cuts; None if no group is hot.

    Counts ``df`` at once, unless it is surely small; the rows of hot groups are read once more. A plan
    serves any frame whose groups are among those of ``df``, row by row: cuts need not be even.
    """
    if surely_small(df, slicing):
        return None
    spark = df.sparkSession
    numbered = df.select(*keys, order).withColumn("_cut_x", _number(df, order))
    groups = _hot_groups(numbered, keys, slicing)
    path = work_folder(spark)
    groups.write.parquet(path + "/groups")
    groups = spark.read.schema(groups.schema).parquet(path + "/groups")
    if groups.isEmpty():
        return None
    hot_rows = _hot_rows(numbered, groups, keys, order).persist()
    try:
        plan = _cuts(hot_rows, groups, keys, order, slicing)
        plan.write.parquet(path + "/cuts")
    finally:
        hot_rows.unpersist()
    return spark.read.schema(plan.schema).parquet(path + "/cuts")


def sliced(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    slicing: Slicing = DEFAULT,
    like: DataFrame | None = None,
) -> DataFrame:
    """Add ``_slice``, ``_sub`` (order-preserving) and ``_hot``.

    like: a frame that is cheaper to read and has at least the groups of ``df``, to be cut by.
    """
    plan = cut_plan(df if like is None else like, keys, order, slicing)
    if plan is None:
        none = F.lit(0).cast("bigint")
        return df.select("*", F.lit(False).alias("_hot"), none.alias("_slice"), none.alias("_sub"))
    numbered = df.withColumn("_cut_x", _number(df, order))
    joined = attach(numbered, plan, keys)
    joined = joined.withColumn("_cut_b", _bucket(F.col("_cut_x"), F.col("_cut_low"), F.col("_cut_high")))
    joined = joined.withColumn("_cut_f", _fine(F.col("_cut_x")))
    hot = F.col("_cut_starts").isNotNull()
    heavy = F.coalesce("_cut_heavy", F.array().cast(ArrayType(df.schema[order].dataType)))
    below = F.size(F.filter("_cut_starts", lambda c: c <= F.col("_cut_f")))
    lighter = F.size(F.filter(heavy, lambda c: c < F.col(order)))
    on_heavy = F.coalesce(F.array_contains(heavy, F.col(order)), F.lit(False))
    step = (2 * lighter + on_heavy.cast("int")).cast("bigint") * (slicing.parts + 2) + below
    sub = F.coalesce(F.floor(F.col(ties[0]) / slicing.tie_rows), F.lit(0)) if ties else F.lit(0)
    return joined.select(
        *df.columns,
        hot.alias("_hot"),
        F.when(hot, step).otherwise(0).alias("_slice"),
        F.when(hot & on_heavy, sub.cast("bigint")).otherwise(0).alias("_sub"),
    )


def _inside(keys: Sequence[str], order: str, ties: Sequence[str]):
    return W.partitionBy(*keys, *_SLICE).orderBy(order, *ties)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    ties: Sequence[str] = (),
    slicing: Slicing = DEFAULT,
    like: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums per group, as new columns named by ``sums``; like: as for ``sliced``."""
    inputs = df.select("*", *(value.alias("_v_" + name) for name, value in sums.items()))
    cut = sliced(inputs, keys, order, ties, slicing, like)
    rows = _inside(keys, order, ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumns({"_l_" + name: F.sum("_v_" + name).over(rows) for name in sums})

    earlier = (
        W.partitionBy(*keys).orderBy(*_SLICE).rowsBetween(W.unboundedPreceding, -1)
    )
    carry = (
        cut.where("_hot")
        .groupBy(*keys, *_SLICE)
        .agg(*(F.sum("_v_" + name).alias("_t_" + name) for name in sums))
        .select(
            *keys, *_SLICE, *(F.sum("_t_" + name).over(earlier).alias("_c_" + name) for name in sums)
        )
    )
    joined = attach(local, carry, [*keys, *_SLICE])
    return joined.select(
        *df.columns,
        *(
            (F.col("_l_" + name) + F.coalesce(F.col("_c_" + name), F.lit(0))).alias(name)
            for name in sums
        ),
    )


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    ties: Sequence[str] = (),
    slicing: Slicing = DEFAULT,
    like: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based position of each row in its group."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, ties, slicing, like)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    ties: Sequence[str],
    inclusive: bool = True,
    slicing: Slicing = DEFAULT,
) -> DataFrame:
    """Latest non-null ``value`` up to (or strictly before) each row of its group."""
    inputs = df.withColumn("_v", value)
    cut = sliced(inputs, keys, order, ties, slicing)
    end = W.currentRow if inclusive else -1
    rows = _inside(keys, order, ties).rowsBetween(W.unboundedPreceding, end)
    local = cut.withColumn("_l", F.last("_v", ignorenulls=True).over(rows))

    earlier = (
        W.partitionBy(*keys).orderBy(*_SLICE).rowsBetween(W.unboundedPreceding, -1)
    )
    carry = (
        cut.where(F.col("_hot") & F.col("_v").isNotNull())
        .groupBy(*keys, *_SLICE)
        .agg(F.max_by("_v", F.struct(order, *ties)).alias("_t"))
        # Slices without a value still need the carry of the ones before them.
        .unionByName(
            cut.where(F.col("_hot") & F.col("_v").isNull())
            .select(*keys, *_SLICE)
            .distinct()
            .withColumn("_t", F.lit(None).cast(inputs.schema["_v"].dataType))
        )
        .groupBy(*keys, *_SLICE)
        .agg(F.first("_t", ignorenulls=True).alias("_t"))
        .select(*keys, *_SLICE, F.last("_t", ignorenulls=True).over(earlier).alias("_c"))
    )
    joined = attach(local, carry, [*keys, *_SLICE])
    return joined.select(*df.columns, F.coalesce("_l", "_c").alias(name))
