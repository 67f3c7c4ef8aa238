"""Exact percentiles, load summaries and threshold verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.operators import ordered, selection


def _ordered(df: DataFrame, groups: list[str], value: str, ranks: selection.Ranks) -> DataFrame:
    """(groups, _n, _lo_<name>, _hi_<name>): values at ranks, by ordering each group's distinct values.

    Equal values collapse inside each task first, so no task holds a group's values, as the built-in exact
    percentile would."""
    tallied = df.groupBy(*groups, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(*groups)
    upto = whole.orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = tallied.withColumns({"_cum": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)})
    at = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_x")))
    return ranked.groupBy(*groups, "_n").agg(
        *(column for name, (_, low, high) in ranks.items() for column in (at(low).alias("_lo_" + name), at(high).alias("_hi_" + name)))
    )


def _at_ranks(
    df: DataFrame, groups: list[str], value: str, ranks: selection.Ranks, slicing: ordered.Slicing
) -> DataFrame:
    """Values at ranks; groups above the bound are not ordered but searched."""
    known = df.where(F.col(value).isNotNull())
    if ordered.surely_small(known.select(*groups, value), slicing):
        return _ordered(known, groups, value, ranks)
    counts = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    hot = selection.stored(counts.where(F.col("_size") > slicing.hot_rows))
    if hot.isEmpty():
        return _ordered(known, groups, value, ranks)
    renamed = hot.select(*(F.col(g).alias("_r_" + g) for g in groups))
    is_hot = ordered.same_keys(known, renamed, groups, "_r_")
    large = known.join(renamed, is_hot, "left_semi")
    sketches = selection.stored(selection.sketched(large, groups, value))
    found = selection.selected(known, sketches, groups, value, ranks)
    return found.unionByName(_ordered(known.join(renamed, is_hot, "left_anti"), groups, value, ranks))


def percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    named: Mapping[str, float],
    exclusive: bool = False,
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """Exact percentiles (0 to 100) per group, one column per name.

    The usual rule interpolates at p·(n−1); the exclusive rule at p·(n+1), with the neighbours
    kept inside the data, and a single value standing for itself.
    """
    groups = list(groups)
    if not groups:
        keyed = df.withColumn("_all", F.lit(0))
        return percentiles(keyed, ["_all"], value, named, exclusive, slicing).drop("_all")
    n = F.col("_n")

    def bounds(p: float) -> tuple[Column, Column, Column]:
        if not exclusive:
            # p·(n−1)/100 in whole numbers where p is whole, so that no rank is lost to rounding.
            place = F.lit(float(p)) * (n - 1) / 100.0
            low = F.floor(place)
            return low, F.least(low + 1, n - 1), place - low
        place = F.lit(float(p)) * (n + 1) / 100.0
        j = F.greatest(F.lit(1), F.least(F.floor(place), n - 1))
        return F.greatest(j - 1, F.lit(0)), F.least(j, n - 1), F.when(n == 1, 0.0).otherwise(place - j)

    picked = _at_ranks(df, groups, value, {name: (p / 100, *bounds(p)[:2]) for name, p in named.items()}, slicing)
    return picked.select(
        *groups,
        *(
            (F.col("_lo_" + name) * (1 - bounds(p)[2]) + F.col("_hi_" + name) * bounds(p)[2]).alias(name)
            for name, p in named.items()
        ),
    )


def load_summary(
    requests: DataFrame, groups: Sequence[str] = (), slicing: ordered.Slicing = ordered.DEFAULT
) -> DataFrame:
    """Request log (ok, latency_ms, at) to counts, success rate, rate and latencies."""
    groups = list(groups)
    keyed = requests if groups else requests.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    span = (F.max(F.unix_micros("at")) - F.min(F.unix_micros("at"))) / 1_000_000
    totals = keyed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.count_if("ok") * 100.0 / F.count(F.lit(1))).alias("success_rate"),
        F.when(span > 0, F.count(F.lit(1)) / span).alias("per_second"),
        F.avg("latency_ms").alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
    p95 = percentiles(keyed, by, "latency_ms", {"p95_ms": 95}, exclusive=True, slicing=slicing)
    out = ordered.attach(totals, p95, by)
    return out if groups else out.drop("_all")


def throughput(events: DataFrame, groups: Sequence[str], at: str) -> DataFrame:
    """Events per second between the first and the last event of each group."""
    span = (F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / 1_000_000
    return events.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("events"),
        F.when(span > 0, F.count(F.lit(1)) / span).alias("per_second"),
    )


def verdict(summary: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Check a summary against ``column: ("min" | "max", bound)`` rules.

    Adds failures (texts, in rule order) and passed.
    """
    checks = []
    for column, (kind, bound) in rules.items():
        broken = F.col(column) < bound if kind == "min" else F.col(column) > bound
        word = "below" if kind == "min" else "above"
        checks.append(F.when(broken, F.lit(f"{column} {word} {bound}")))
    failures = F.array_compact(F.array(*checks))
    return summary.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
