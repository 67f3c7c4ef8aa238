"""Values at given ranks of large groups, exactly, without ordering the groups.

A mergeable quantile sketch tells between which two values a rank must lie, but for its error. One pass
then counts what lies below that bracket and tallies the values inside, which is all that has to be
ranked: a few hundredths of a group. The counts also show whether the bracket does hold the rank; where a
sketch was further off than expected, the pass is repeated with a wider bracket, at last with no bounds.
So the result is exact whatever the sketch says.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.operators import ordered
from changetide.session import work_folder

#: Size of the sketches; their error is about 2.5 / SKETCH of a group.
SKETCH = 800
#: How far brackets reach to either side of a rank, as shares of a group; 1 has no bounds.
MARGINS = (0.01, 0.1, 1.0)

#: By name: the share of a group below, about, and the two ranks themselves, columns over ``_n``.
Ranks = Mapping[str, tuple[float, Column, Column]]


def stored(frame: DataFrame) -> DataFrame:
    path = work_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _number(value: str) -> Column:
    return F.col(value).cast("double")


def sketched(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, _n, _sketch): number of values, and a sketch of those that are no NaN, which come last."""
    x = _number(value)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double(F.when(~F.isnan(x), x), SKETCH).alias("_sketch")
    )


def _brackets(sketches: DataFrame, groups: Sequence[str], ranks: Ranks, margin: float) -> DataFrame:
    """(groups, _n, _brackets): per name its place, its bounds (null: none) and its two ranks."""
    n = F.col("_n")

    def bracket(place: int, share: float, low: Column, high: Column) -> Column:
        def at(point: float) -> Column:
            inside = 0 < point < 1
            return F.when(F.lit(inside), F.kll_sketch_get_quantile_double("_sketch", F.lit(point if inside else 0.5)))

        return F.struct(
            F.lit(place).alias("j"),
            F.when(F.kll_sketch_get_n_double("_sketch") > 0, at(share - margin)).alias("a"),
            F.when(F.kll_sketch_get_n_double("_sketch") > 0, at(share + margin)).alias("b"),
            low.cast("bigint").alias("low"),
            high.cast("bigint").alias("high"),
        )

    found = [bracket(i, *rank) for i, rank in enumerate(ranks.values())]
    return sketches.select(*groups, n, F.array(*found).alias("_brackets"))


def _tallied(df: DataFrame, brackets: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, _j, _x, _c): how often each value inside a bracket occurs; _x null: all below it."""
    x = _number(value)
    kind = df.schema[value].dataType

    def place(b: Column) -> Column:
        below = F.coalesce(x < b["a"], F.lit(False))
        inside = F.coalesce(x <= b["b"], F.lit(True))
        entry = lambda v: F.struct(b["j"].alias("_j"), v.cast(kind).alias("_x"))
        return F.when(below, entry(F.lit(None))).when(inside, entry(F.col(value)))

    rows = ordered.attach(df.select(*groups, value), brackets, groups, "inner")
    laid = rows.select(*groups, F.inline(F.array_compact(F.transform("_brackets", place))))
    return laid.groupBy(*groups, "_j", "_x").agg(F.count(F.lit(1)).alias("_c"))


def _missed(tally: DataFrame, brackets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Groups with a bracket that doesn't hold its ranks."""
    counts = tally.groupBy(*groups, "_j").agg(
        F.sum(F.when(F.col("_x").isNull(), F.col("_c")).otherwise(0)).alias("_below"), F.sum("_c").alias("_upto")
    )
    wanted = brackets.select(*groups, F.inline("_brackets")).withColumnRenamed("j", "_j")
    held = (F.col("_below") <= F.col("low")) & (F.col("_upto") > F.col("high"))
    checked = ordered.attach(wanted, counts, [*groups, "_j"])
    return checked.where(~F.coalesce(held, F.lit(False))).select(*groups).distinct()


def selected(df: DataFrame, sketches: DataFrame, groups: Sequence[str], value: str, ranks: Ranks) -> DataFrame:
    """(groups, _n, _lo_<name>, _hi_<name>) for the groups of sketches: the values at the two ranks of a name.

    df has no null values; ranks are 0-based."""
    groups = list(groups)
    found: DataFrame | None = None
    left = sketches
    for margin in MARGINS:
        brackets = stored(_brackets(left, groups, ranks, margin))
        tally = stored(_tallied(df, brackets, groups, value))
        missed = stored(_missed(tally, brackets, groups))
        done = missed.isEmpty()
        if not done:
            renamed = missed.select(*(F.col(g).alias("_r_" + g) for g in groups))
            brackets = brackets.join(renamed, ordered.same_keys(brackets, renamed, groups, "_r_"), "left_anti")
        picked = _picked(tally, brackets, groups, ranks)
        found = picked if found is None else found.unionByName(picked)
        if done:
            break
        left = ordered.attach(left, missed, groups, "inner")
    return found


def _picked(tally: DataFrame, brackets: DataFrame, groups: list[str], ranks: Ranks) -> DataFrame:
    # null, what lies below, is first
    ranked = ordered.running_sum(tally, [*groups, "_j"], "_x", {"_cum": F.col("_c")})
    rows = ordered.attach(ranked.where(F.col("_x").isNotNull()), brackets, groups, "inner")
    own = F.get("_brackets", F.col("_j"))
    at = lambda i, rank: F.min(F.when((F.col("_j") == i) & (F.col("_cum") > own[rank]), F.col("_x")))
    return rows.groupBy(*groups, "_n").agg(
        *(
            column
            for i, name in enumerate(ranks)
            for column in (at(i, "low").alias("_lo_" + name), at(i, "high").alias("_hi_" + name))
        )
    )
