"""Percentiles, rates, service levels and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from changetide.operators import ordered, slo, stats
from workload.samples import Registry, events, table

queries = Registry()

SMALL = ordered.Slicing(hot_rows=50, parts=8, tie_rows=100)
BOUNDS = (5, 10, 25, 50, 100, 250)


@queries.add(
    "percentile_linear",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def percentile_linear(spark, sf):
    found = stats.percentiles(
        events(spark, sf), ["event_type"], "value", {"p50": 50, "p95": 95, "p99": 99}, slicing=SMALL
    )
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@queries.add(
    "percentile_exclusive",
    """WITH s AS (SELECT user_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)),
j AS (SELECT *, 95 * (n + 1) / 100.0 AS place, greatest(1, least(floor(95 * (n + 1) / 100.0), n - 1)) AS j FROM s)
SELECT user_id, round(CASE WHEN max(n) = 1 THEN max(value) ELSE
  max(CASE WHEN rn = j THEN value END) * (1 - (max(place) - max(j))) + max(CASE WHEN rn = j + 1 THEN value END) * (max(place) - max(j)) END, 6) AS p95
FROM j GROUP BY user_id""",
)
def percentile_exclusive(spark, sf):
    """The p·(n+1) rule per user."""
    found = stats.percentiles(events(spark, sf), ["user_id"], "value", {"p95": 95}, exclusive=True)
    return found.select("user_id", F.round("p95", 6).alias("p95"))


@queries.add(
    "price_percentiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem""",
)
def price_percentiles(spark, sf):
    """Whole-table percentiles; the single group is ranked in slices."""
    found = stats.percentiles(
        table(spark, sf, "lineitem"), [], "l_extendedprice", {"p50": 50, "p95": 95},
        slicing=ordered.Slicing(hot_rows=1000, parts=16),
    )
    return found.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def _requests(spark, sf):
    return events(spark, sf).select(
        "event_type",
        F.expr("event_id % 9 <> 0").alias("ok"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("at"),
    )


@queries.add(
    "load_summary",
    """WITH s AS (SELECT event_type, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events),
j AS (SELECT *, 95 * (n + 1) / 100.0 AS place, floor(95 * (n + 1) / 100.0) AS j FROM s)
SELECT event_type, count(*) AS requests, count(*) FILTER (event_id % 9 <> 0) AS succeeded,
  count(*) FILTER (event_id % 9 = 0) AS failed,
  round(count(*) FILTER (event_id % 9 <> 0) * 100.0 / count(*), 6) AS success_rate,
  round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0), 6) AS per_second,
  round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(max(CASE WHEN rn = j THEN value END) * (1 - (max(place) - max(j))) + max(CASE WHEN rn = j + 1 THEN value END) * (max(place) - max(j)), 6) AS p95_ms
FROM j GROUP BY event_type""",
)
def load_summary(spark, sf):
    found = stats.load_summary(_requests(spark, sf), ["event_type"])
    rounded = ("success_rate", "per_second", "avg_ms", "p95_ms")
    return found.select(*(F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in found.columns))


@queries.add(
    "load_verdict",
    """SELECT event_type, concat_ws('; ',
    CASE WHEN avg(CASE WHEN event_id % 9 <> 0 THEN 100.0 ELSE 0 END) < 89 THEN 'success_rate below 89' END,
    CASE WHEN max(value) > 150 THEN 'max_ms above 150' END) AS failures,
  NOT (avg(CASE WHEN event_id % 9 <> 0 THEN 100.0 ELSE 0 END) < 89 OR max(value) > 150) AS passed
FROM events GROUP BY event_type""",
)
def load_verdict(spark, sf):
    summary = stats.load_summary(_requests(spark, sf), ["event_type"])
    judged = stats.verdict(summary, {"success_rate": ("min", 89), "max_ms": ("max", 150)})
    return judged.select("event_type", F.array_join("failures", "; ").alias("failures"), "passed")


@queries.add(
    "throughput",
    """SELECT event_type, count(*) AS events,
  round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0), 6) AS per_second FROM events GROUP BY event_type""",
)
def throughput(spark, sf):
    found = stats.throughput(events(spark, sf), ["event_type"], "ts")
    return found.select("event_type", "events", F.round("per_second", 6).alias("per_second"))


@queries.add(
    "rate_by_type",
    """SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS window_s, round(count(*) / 3600.0, 9) AS rate
FROM events GROUP BY ALL""",
)
def rate_by_type(spark, sf):
    found = slo.rate(events(spark, sf), ["event_type"], "ts", 3600)
    return found.select(
        "event_type", F.unix_seconds("window_start").alias("window_s"), F.round("rate", 9).alias("rate")
    )


@queries.add(
    "counter_rate",
    """WITH s AS (SELECT user_id % 3 AS lab, user_id, ts, CAST(event_id % 100 AS DOUBLE) AS v,
  lag(CAST(event_id % 100 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
SELECT lab AS label, epoch_us(ts) // 7200000000 * 7200 AS window_s,
  round(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) / 7200.0, 9) AS rate FROM s GROUP BY ALL""",
)
def counter_rate(spark, sf):
    """Counter samples per user with resets, summed to three labels."""
    samples = events(spark, sf).select(
        (F.col("user_id") % 3).alias("label"), "user_id", "ts",
        (F.col("event_id") % 100).cast("double").alias("value"),
    )
    found = slo.counter_rate(samples, ["label"], ["user_id"], 7200, SMALL)
    return found.select(
        "label", F.unix_seconds("window_start").alias("window_s"), F.round("rate", 9).alias("rate")
    )


_HIST = """WITH h AS (SELECT event_type, b AS le, count(*) FILTER (value <= b) AS n
  FROM events, (VALUES (5.0::DOUBLE), (10), (25), (50), (100), (250), ('inf'::DOUBLE)) AS t(b) GROUP BY ALL),
r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before,
  0.95 * max(n) OVER (PARTITION BY event_type) AS rk FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
"""


@queries.add(
    "latency_histogram",
    _HIST + "SELECT event_type, CAST(le AS VARCHAR) AS le, n FROM h",
)
def latency_histogram(spark, sf):
    buckets = slo.histogram(events(spark, sf), ["event_type"], "value", BOUNDS)
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return buckets.select("event_type", le.alias("le"), "n")


@queries.add(
    "histogram_quantile",
    _HIST
    + """SELECT event_type, round(arg_min(CASE WHEN le > 1000 THEN low WHEN n = before THEN le
  ELSE low + (le - low) * (rk - before) / (n - before) END, le), 6) AS quantile
FROM r WHERE n >= rk GROUP BY event_type""",
)
def histogram_quantile(spark, sf):
    buckets = slo.histogram(events(spark, sf), ["event_type"], "value", BOUNDS)
    found = slo.histogram_quantile(buckets, ["event_type"], 0.95)
    return found.select("event_type", F.round("quantile", 6).alias("quantile"))


@queries.add("gauge_max", "SELECT event_type, max(value) AS value FROM events GROUP BY event_type")
def gauge_max(spark, sf):
    return slo.max_by_labels(events(spark, sf), ["event_type"])


def _cohorts(spark, sf):
    return events(spark, sf).withColumn(
        "cohort", F.expr("CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END")
    )


_COHORTS = """WITH o AS (SELECT CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS cohort,
  event_type = 'error' AS bad, epoch_us(ts) AS us,
  CAST(ceil(epoch_us(ts) / 60000000.0) * 60 AS BIGINT) AS step, event_type, value, event_id FROM events),
pol AS (SELECT * FROM (VALUES ('small', 0.1, 180, 500), ('medium', 0.5, 300, 1000), ('large', 1.0, 600, 5000)) AS t(cohort, budget, age, lag)),
s AS (SELECT cohort, step, count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS failed FROM o GROUP BY ALL),
sli AS (SELECT cohort, step,
  sum(ok) OVER a / greatest(CAST(sum(ok + failed) OVER a AS DOUBLE), 1e-9) AS s5,
  sum(ok) OVER b / greatest(CAST(sum(ok + failed) OVER b AS DOUBLE), 1e-9) AS s30,
  sum(ok) OVER c / greatest(CAST(sum(ok + failed) OVER c AS DOUBLE), 1e-9) AS s60,
  sum(ok) OVER d / greatest(CAST(sum(ok + failed) OVER d AS DOUBLE), 1e-9) AS s360
  FROM s WINDOW a AS (PARTITION BY cohort ORDER BY step RANGE BETWEEN 299 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY cohort ORDER BY step RANGE BETWEEN 1799 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY cohort ORDER BY step RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY cohort ORDER BY step RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW))
"""


def _sli(spark, sf):
    counts = slo.step_counts(_cohorts(spark, sf), ["cohort"], "ts", F.col("event_type") == "error")
    return slo.rolling_sli(counts, ["cohort"])


@queries.add(
    "sli_rolling",
    _COHORTS
    + """SELECT cohort, step, round(s5, 6) AS sli_5m, round(s30, 6) AS sli_30m, round(s60, 6) AS sli_1h, round(s360, 6) AS sli_6h FROM sli""",
)
def sli_rolling(spark, sf):
    found = _sli(spark, sf)
    return found.select("cohort", "step", *(F.round(f"sli_{h}", 6).alias(f"sli_{h}") for h in slo.HORIZONS))


@queries.add(
    "burn_rate",
    _COHORTS
    + """SELECT sli.cohort, step, round((1 - s5) / (budget / 100), 4) AS burn_5m, round((1 - s30) / (budget / 100), 4) AS burn_30m,
  round((1 - s60) / (budget / 100), 4) AS burn_1h, round((1 - s360) / (budget / 100), 4) AS burn_6h,
  (1 - s60) / (budget / 100) > 14.4 AND (1 - s5) / (budget / 100) > 14.4 AS fast,
  (1 - s360) / (budget / 100) > 6 AND (1 - s30) / (budget / 100) > 6 AS slow
FROM sli JOIN pol USING (cohort)""",
)
def burn_rate(spark, sf):
    found = slo.burn_rates(_sli(spark, sf), slo.cohort_policies(spark))
    burns = (F.round(f"burn_{h}", 4).alias(f"burn_{h}") for h in slo.HORIZONS)
    return found.select("cohort", "step", *burns, "fast", "slow")


@queries.add(
    "alert_for",
    """WITH b AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS step, event_type, count(*) FILTER (user_id % 2 = 0) AS n FROM events GROUP BY ALL),
t AS (SELECT *, step - row_number() OVER (PARTITION BY event_type ORDER BY step) * 3600 AS island FROM b WHERE n >= 1)
SELECT event_type, min(step) AS pending_since, min(step) + 7200 AS firing_since, max(step) AS until
FROM t GROUP BY event_type, island HAVING max(step) - min(step) >= 7200""",
)
def alert_for(spark, sf):
    """Hours in a row with traffic of even users, held for two hours."""
    step = (F.floor(F.unix_micros("ts") / 3_600_000_000) * 3600).alias("step")
    hours = events(spark, sf).groupBy("event_type", step).agg(
        (F.count_if(F.expr("user_id % 2 = 0")) >= 1).alias("busy")
    )
    return slo.firing(hours, ["event_type"], "busy", 7200, 3600)


@queries.add(
    "freshness_sli",
    _COHORTS
    + """, k AS (SELECT cohort, step, max(us) AS last FROM o GROUP BY ALL),
g AS (SELECT cohort, unnest(range(min(step), max(step) + 60, 60)) AS step FROM k GROUP BY cohort),
f AS (SELECT g.cohort, g.step, last_value(k.last IGNORE NULLS) OVER (PARTITION BY g.cohort ORDER BY g.step) AS last
  FROM g LEFT JOIN k ON g.cohort = k.cohort AND g.step = k.step),
j AS (SELECT f.*, CASE WHEN step - last / 1000000.0 <= age THEN 1 ELSE 0 END AS fresh FROM f JOIN pol USING (cohort))
SELECT cohort, step, round(step - last / 1000000.0, 6) AS staleness,
  round(avg(fresh) OVER (PARTITION BY cohort ORDER BY step RANGE BETWEEN 299 PRECEDING AND CURRENT ROW), 6) AS fresh_5m,
  round(avg(fresh) OVER (PARTITION BY cohort ORDER BY step RANGE BETWEEN 1799 PRECEDING AND CURRENT ROW), 6) AS fresh_30m,
  round(avg(fresh) OVER (PARTITION BY cohort ORDER BY step RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), 6) AS fresh_1h,
  round(avg(fresh) OVER (PARTITION BY cohort ORDER BY step RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW), 6) AS fresh_6h FROM j""",
)
def freshness_sli(spark, sf):
    """Every event is a commit of its cohort; judged at every minute."""
    found = slo.freshness_sli(_cohorts(spark, sf), slo.cohort_policies(spark), "ts")
    shares = (F.round(f"fresh_{h}", 6).alias(f"fresh_{h}") for h in slo.HORIZONS)
    return found.select("cohort", "step", F.round("staleness", 6).alias("staleness"), *shares)


@queries.add(
    "error_budget_left",
    _COHORTS
    + """SELECT s.cohort, round(budget / 100 * 43200, 6) AS budget_minutes, CAST(count(*) FILTER (failed > 0) AS DOUBLE) AS violating_minutes,
  round(budget / 100 * 43200 - count(*) FILTER (failed > 0), 6) AS minutes_left FROM s JOIN pol USING (cohort) GROUP BY s.cohort, budget""",
)
def error_budget_left(spark, sf):
    counts = slo.step_counts(_cohorts(spark, sf), ["cohort"], "ts", F.col("event_type") == "error")
    left = slo.budget_left(
        counts.withColumn("good", F.col("failed") == 0), slo.cohort_policies(spark), "good"
    )
    return left.select(
        "cohort",
        F.round("budget_minutes", 6).alias("budget_minutes"),
        "violating_minutes",
        F.round("minutes_left", 6).alias("minutes_left"),
    )


@queries.add(
    "lag_above_cohort_limit",
    _COHORTS
    + """SELECT o.cohort, step, max(event_id % 6000) AS value, lag AS bound, max(event_id % 6000) > lag AS over
FROM o JOIN pol USING (cohort) GROUP BY o.cohort, step, lag""",
)
def lag_above_cohort_limit(spark, sf):
    samples = _cohorts(spark, sf).select(
        "cohort", slo.step_of(F.col("ts")).alias("step"), (F.col("event_id") % 6000).alias("value")
    )
    return slo.above_cohort_limit(samples, slo.cohort_policies(spark), "max_consumer_lag")


@queries.add(
    "lag_alerts_held",
    _COHORTS
    + """, v AS (SELECT o.cohort, step, max(event_id % 6000) > lag AS over FROM o JOIN pol USING (cohort) GROUP BY o.cohort, step, lag),
t AS (SELECT *, step - row_number() OVER (PARTITION BY cohort ORDER BY step) * 60 AS island FROM v WHERE over)
SELECT cohort, min(step) AS pending_since, min(step) + 120 AS firing_since, max(step) AS until
FROM t GROUP BY cohort, island HAVING max(step) - min(step) >= 120""",
)
def lag_alerts_held(spark, sf):
    """Lag above the cohort's limit at every minute for two minutes."""
    return slo.cohort_alerts(
        _cohorts(spark, sf).select("cohort", slo.step_of(F.col("ts")).alias("step"), (F.col("event_id") % 6000).alias("value")),
        slo.cohort_policies(spark), "max_consumer_lag", 120,
    )


@queries.add(
    "threshold_alerts",
    """WITH b AS (SELECT event_type AS metric, epoch_us(ts) // 1800000000 * 1800 AS step, max(value) AS value FROM events GROUP BY ALL),
r AS (SELECT * FROM (VALUES ('error', 15.0, 1800), ('view', 20.0, 3600)) AS t(metric, bound, hold)),
t AS (SELECT b.*, hold, step - row_number() OVER (PARTITION BY b.metric ORDER BY step) * 1800 AS island FROM b JOIN r USING (metric) WHERE value > bound)
SELECT metric, min(step) AS pending_since, min(step) + hold AS firing_since, max(step) AS until
FROM t GROUP BY metric, hold, island HAVING max(step) - min(step) >= hold""",
)
def threshold_alerts(spark, sf):
    """Static rules over half-hour maxima."""
    step = (F.floor(F.unix_micros("ts") / 1_800_000_000) * 1800).alias("step")
    samples = events(spark, sf).select(F.col("event_type").alias("metric"), step, "value")
    rules = spark.createDataFrame(
        [("error", 15.0, 1800), ("view", 20.0, 3600)], "metric string, bound double, hold int"
    )
    return slo.threshold_alerts(samples, rules, 1800)


_RUNS = """WITH s AS (SELECT {key} AS grp, ts, event_type IN ('error', 'view', 'click') AS bad,
  count(*) FILTER (event_type NOT IN ('error', 'view', 'click')) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS wins,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT grp, wins, epoch_us(ts) AS us, row_number() OVER (PARTITION BY grp, wins ORDER BY rn) AS k FROM s WHERE bad)
SELECT grp, count(*) AS failures, min(us) AS started_us, max(CASE WHEN k = 5 THEN us END) AS opened_us,
  max(us) AS last_us, max(us) + 30000000 AS half_open_us FROM r GROUP BY grp, wins HAVING count(*) >= 5"""


def _runs(spark, sf, key, slicing):
    rows = events(spark, sf).withColumn("grp", key)
    failed = F.col("event_type").isin("error", "view", "click")
    runs = slo.failure_runs(rows, ["grp"], "ts", failed, ties=("event_id",), slicing=slicing)
    us = lambda c: F.unix_micros(c)
    return runs.select(
        "grp", "failures", us("started_at").alias("started_us"), us("opened_at").alias("opened_us"),
        us("last_failure_at").alias("last_us"), us("half_open_at").alias("half_open_us"),
    )


@queries.add("failure_runs", _RUNS.format(key="user_id"))
def failure_runs(spark, sf):
    return _runs(spark, sf, F.col("user_id"), ordered.DEFAULT)


@queries.add("failure_runs_sliced", _RUNS.format(key="user_id % 2"))
def failure_runs_sliced(spark, sf):
    """Two hot series, each cut into slices that runs may cross."""
    return _runs(spark, sf, F.col("user_id") % 2, SMALL)
