"""Service levels: rates, histogram quantiles, rolling SLIs, burn rates and alerts.

Raw samples are first counted into steps per series (with map-side combine). Rolling windows then
run over one row per series and step, whose number is bounded by the time span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.operators import ordered

# Rolling windows, burn thresholds and cohort policies.
HORIZONS = {"5m": 300, "30m": 1_800, "1h": 3_600, "6h": 21_600}
FAST_BURN = (14.4, "1h", "5m", 120)
SLOW_BURN = (6.0, "6h", "30m", 300)
STEP = 60
COHORT_POLICIES = (
    # name, max sources, availability target %, error budget %, max commit age s, max lag, max dead letters
    ("small", 10, 99.9, 0.1, 180, 500, 0),
    ("medium", 50, 99.5, 0.5, 300, 1000, 5),
    ("large", 100, 99.0, 1.0, 600, 5000, 20),
)
THRESHOLD_ALERTS = (
    # metric, comparison bound, seconds it must hold
    ("events_failed_per_second", 1.0, 60),
    ("api_p95_seconds", 1.0, 300),
    ("pool_utilization", 0.9, 300),
    ("pool_overflow", 0.0, 300),
    ("consumer_lag", 1000.0, 300),
    ("commit_age_seconds", 300.0, 300),
    ("dead_letters_pending", 0.0, 300),
    ("spill_pending", 50.0, 300),
    ("auth_failures_per_second", 5.0, 300),
)


def cohort_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(COHORT_POLICIES),
        "cohort string, max_sources int, availability_target double, error_budget_percent double, "
        "max_commit_age_seconds int, max_consumer_lag int, max_dlq_messages int",
    )


def step_of(ts: Column, step: int = STEP) -> Column:
    """Evaluation step (epoch seconds) that first sees a sample: the step's end."""
    return (F.ceil(F.unix_micros(ts) / (step * 1_000_000)) * step).cast("bigint")


def rate(events: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """Events per second in tumbling windows."""
    start = F.floor(F.unix_micros(at) / (seconds * 1_000_000)) * seconds
    return events.groupBy(*keys, F.timestamp_seconds(start).alias("window_start")).agg(
        (F.count(F.lit(1)) / float(seconds)).alias("rate")
    )


def counter_rate(
    samples: DataFrame,
    labels: Sequence[str],
    series: Sequence[str],
    seconds: int,
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """Rate of a counter per window, summed over series to ``labels``.

    A value below its predecessor is a counter reset and counts from zero. Windows are not
    extrapolated to their edges. Input: series columns, ts, value.
    """
    at = samples.withColumn("_at", F.unix_micros("ts"))
    seen = ordered.carry_last(
        at, series, "_at", F.struct("value"), "_prev", ("value",), inclusive=False, slicing=slicing
    )
    prev = F.col("_prev.value")
    growth = F.when(prev.isNull(), 0.0).when(F.col("value") < prev, F.col("value")).otherwise(
        F.col("value") - prev
    )
    start = F.floor(F.col("_at") / (seconds * 1_000_000)) * seconds
    return seen.groupBy(*labels, F.timestamp_seconds(start).alias("window_start")).agg(
        (F.sum(growth) / float(seconds)).alias("rate")
    )


def histogram(events: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts; the last bound is infinity."""
    counts = events.groupBy(*keys).agg(
        *(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)),
        F.count(value).alias(f"_b{len(bounds)}"),
    )
    edges = [*map(float, bounds), float("inf")]
    pairs = F.array(
        *(F.struct(F.lit(e).alias("le"), F.col(f"_b{i}").alias("n")) for i, e in enumerate(edges))
    )
    return counts.select(*keys, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Quantile by linear interpolation in the first bucket that reaches it.

    A quantile that falls into the infinite bucket is the highest finite bound. Input: keys, le, n
    (cumulative), from any number of series, which are summed.
    """
    summed = buckets.groupBy(*keys, "le").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*keys).orderBy("le")
    whole = W.partitionBy(*keys)
    placed = summed.select(
        *keys,
        "le",
        "n",
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("n").over(order), F.lit(0)).alias("before"),
        (F.lit(q) * F.max("n").over(whole)).alias("rank"),
    )
    inside = F.col("n") - F.col("before")
    value = (
        F.when(F.col("le") == float("inf"), F.col("low"))
        .when(inside == 0, F.col("le"))
        .otherwise(
            F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / inside
        )
    )
    return (
        placed.where((F.col("n") >= F.col("rank")) & (F.col("rank") > 0))
        .groupBy(*keys)
        .agg(F.min_by(value, "le").alias("quantile"))
    )


def max_by_labels(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    return samples.groupBy(*labels).agg(F.max("value").alias("value"))


def success_ratio(ok: Column, failed: Column) -> Column:
    """Processed over everything; no failures count as zero, an empty window as ratio 0."""
    bad = F.coalesce(failed, F.lit(0))
    good = F.coalesce(ok, F.lit(0))
    return good / F.greatest((good + bad).cast("double"), F.lit(1e-9))


def step_counts(outcomes: DataFrame, keys: Sequence[str], at: str, failed: Column, step: int = STEP) -> DataFrame:
    """Processed and failed counts per series and step."""
    return outcomes.groupBy(*keys, step_of(F.col(at), step).alias("step")).agg(
        F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed")
    )


def rolling_sli(
    counts: DataFrame, keys: Sequence[str], horizons: Mapping[str, int] = HORIZONS
) -> DataFrame:
    """Success ratio over each trailing horizon, at every step that has data."""
    by = W.partitionBy(*keys).orderBy("step")
    columns = []
    for name, seconds in horizons.items():
        window = by.rangeBetween(-(seconds - 1), 0)
        columns.append(
            success_ratio(F.sum("ok").over(window), F.sum("failed").over(window)).alias(f"sli_{name}")
        )
    return counts.select(*keys, "step", *columns)


def burn_rates(
    sli: DataFrame, policies: DataFrame, horizons: Mapping[str, int] = HORIZONS
) -> DataFrame:
    """Error ratio over budget per horizon, with the fast and slow burn conditions."""
    budget = F.col("error_budget_percent") / 100.0
    joined = sli.join(policies.select("cohort", "error_budget_percent"), "cohort")
    burns = joined.select(
        "cohort", "step", *(((1 - F.col(f"sli_{h}")) / budget).alias(f"burn_{h}") for h in horizons)
    )

    def over(rule: tuple) -> Column:
        factor, long, short, _ = rule
        return (F.col(f"burn_{long}") > factor) & (F.col(f"burn_{short}") > factor)

    return burns.withColumns({"fast": over(FAST_BURN), "slow": over(SLOW_BURN)})


def freshness_sli(
    commits: DataFrame,
    policies: DataFrame,
    at: str,
    horizons: Mapping[str, int] = HORIZONS,
    step: int = STEP,
) -> DataFrame:
    """Share of steps whose last commit was recent enough, over trailing horizons.

    The grid has one row per cohort and step from its first commit to its last.
    """
    per_step = commits.groupBy("cohort", step_of(F.col(at), step).alias("step")).agg(
        F.max(F.unix_micros(at)).alias("last")
    )
    grid = per_step.groupBy("cohort").agg(F.min("step").alias("a"), F.max("step").alias("b")).select(
        "cohort", F.explode(F.sequence("a", "b", F.lit(step))).alias("step")
    )
    by = W.partitionBy("cohort").orderBy("step")
    known = grid.join(per_step, ["cohort", "step"], "left").withColumn(
        "last", F.last("last", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    )
    limits = policies.select("cohort", "max_commit_age_seconds")
    staleness = F.col("step") - F.col("last") / 1_000_000
    judged = known.join(limits, "cohort").withColumns(
        {
            "staleness": staleness,
            "fresh": (staleness <= F.col("max_commit_age_seconds")).cast("int"),
        }
    )
    return judged.select(
        "cohort",
        "step",
        "staleness",
        *(
            F.avg("fresh").over(by.rangeBetween(-(s - 1), 0)).alias(f"fresh_{name}")
            for name, s in horizons.items()
        ),
    )


def firing(steps: DataFrame, keys: Sequence[str], condition: str, hold: int, step: int = STEP) -> DataFrame:
    """Periods in which a condition held at every step for at least ``hold`` seconds.

    Input: one row per series and step. A missing step ends a period.
    """
    by = W.partitionBy(*keys).orderBy("step")
    true_steps = steps.where(F.col(condition))
    # Consecutive true steps share step − step_size × place.
    islands = true_steps.withColumn("_island", F.col("step") - F.row_number().over(by) * F.lit(step))
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("step").alias("pending_since"), F.max("step").alias("until"))
        .where(F.col("until") - F.col("pending_since") >= hold)
        .select(*keys, "pending_since", (F.col("pending_since") + hold).alias("firing_since"), "until")
    )


def budget_left(
    steps: DataFrame, policies: DataFrame, good: str, window_days: int = 30, step: int = STEP
) -> DataFrame:
    """Minutes of error budget left per cohort over the whole input window."""
    spent = steps.groupBy("cohort").agg(
        (F.count_if(~F.col(good)) * (step / 60.0)).alias("violating_minutes")
    )
    total = F.col("error_budget_percent") / 100.0 * (window_days * 24 * 60)
    return spent.join(policies, "cohort").select(
        "cohort",
        total.alias("budget_minutes"),
        "violating_minutes",
        (total - F.col("violating_minutes")).alias("minutes_left"),
    )


def above_cohort_limit(samples: DataFrame, policies: DataFrame, limit: str) -> DataFrame:
    """Per cohort and step: highest value and whether it exceeds the cohort's limit."""
    top = samples.groupBy("cohort", "step").agg(F.max("value").alias("value"))
    return top.join(policies.select("cohort", F.col(limit).alias("bound")), "cohort").withColumn(
        "over", F.col("value") > F.col("bound")
    )


def cohort_alerts(
    samples: DataFrame, policies: DataFrame, limit: str, hold: int, step: int = STEP
) -> DataFrame:
    """Periods in which a cohort stayed above its limit for at least ``hold`` seconds."""
    return firing(above_cohort_limit(samples, policies, limit), ["cohort"], "over", hold, step)


def threshold_alerts(samples: DataFrame, rules: DataFrame, step: int = STEP) -> DataFrame:
    """Static rules (metric, bound, hold) over (metric, step, value): firing periods."""
    by = W.partitionBy("metric").orderBy("step")
    over = (
        samples.groupBy("metric", "step")
        .agg(F.max("value").alias("value"))
        .join(rules, "metric")
        .where(F.col("value") > F.col("bound"))
    )
    islands = over.withColumn("_island", F.col("step") - F.row_number().over(by) * F.lit(step))
    return (
        islands.groupBy("metric", "hold", "_island")
        .agg(F.min("step").alias("pending_since"), F.max("step").alias("until"))
        .where(F.col("until") - F.col("pending_since") >= F.col("hold"))
        .select("metric", "pending_since", (F.col("pending_since") + F.col("hold")).alias("firing_since"), "until")
    )


def failure_runs(
    outcomes: DataFrame,
    keys: Sequence[str],
    order: str,
    failed: Column,
    threshold: int = 5,
    recovery_seconds: int = 30,
    ties: Sequence[str] = (),
    slicing: ordered.Slicing = ordered.DEFAULT,
) -> DataFrame:
    """Runs of at least ``threshold`` consecutive failures.

    Every failure carries the number of successes before it, which is the same throughout a run,
    and its own running number, which finds the failure that crossed the threshold. Both are
    running sums, so a hot series is processed in slices.
    """
    keys = list(keys)
    flagged = outcomes.withColumns({"_failed": failed, "_at": F.unix_micros(order)})
    summed = ordered.running_sum(
        flagged,
        keys,
        "_at",
        {
            "_wins": (~F.col("_failed")).cast("bigint"),
            "_losses": F.col("_failed").cast("bigint"),
        },
        ties,
        slicing,
    )
    losses = summed.where("_failed").select(*keys, "_wins", "_losses", F.col(order).alias("_ts"))
    runs = (
        losses.groupBy(*keys, "_wins")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min("_losses").alias("_first"),
            F.min("_ts").alias("started_at"),
            F.max("_ts").alias("last_failure_at"),
        )
        .where(F.col("failures") >= threshold)
        .withColumn("_losses", F.col("_first") + (threshold - 1))
    )
    opened = losses.select(*keys, "_losses", F.col("_ts").alias("opened_at"))
    wait = F.timestamp_micros(F.unix_micros("last_failure_at") + recovery_seconds * 1_000_000)
    return ordered.attach(runs, opened, [*keys, "_losses"]).select(
        *keys, "failures", "started_at", "opened_at", "last_failure_at", wait.alias("half_open_at")
    )
