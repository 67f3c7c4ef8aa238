"""Sliced computations must equal plain windows, whatever the distribution."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changetide.operators import changes, ordered, quota, slo, stats

SLICINGS = [
    ordered.Slicing(hot_rows=10, parts=4, tie_rows=5),
    ordered.Slicing(hot_rows=30, parts=16, tie_rows=1000),
    ordered.DEFAULT,
]


def sample(spark, seed, n=400):
    """One key holds most rows, and one instant holds a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.8 else rng.choice("abc")
        when = 50 if rng.random() < 0.33 else rng.randrange(100)
        value = None if rng.random() < 0.3 else rng.randrange(10)
        rows.append((key if rng.random() < 0.95 else None, when, i, value))
    return spark.createDataFrame(rows, "k string, t long, i long, v int").repartition(3)


@pytest.mark.parametrize("slicing", SLICINGS)
@pytest.mark.parametrize("seed", [1, 2])
def test_running_sum(spark, slicing, seed):
    df = sample(spark, seed)
    w = W.partitionBy("k").orderBy("t", "i").rowsBetween(W.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w))
    mine = ordered.running_sum(df, ["k"], "t", {"s": F.coalesce("v", F.lit(0))}, ["i"], slicing)
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("slicing", SLICINGS)
@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_last(spark, slicing, inclusive):
    df = sample(spark, 3)
    w = W.partitionBy("k").orderBy("t", "i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    plain = df.withColumn("c", F.last("v", ignorenulls=True).over(w))
    mine = ordered.carry_last(df, ["k"], "t", F.col("v"), "c", ["i"], inclusive, slicing)
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_hot_groups_are_really_cut(spark):
    df = sample(spark, 4)
    cut = ordered.sliced(df, ["k"], "t", ["i"], ordered.Slicing(100, 8, 5))
    sizes = cut.where("k = 'hot'").groupBy("_slice", "_sub").count().collect()
    assert len(sizes) > 10
    # The instant with a third of the rows is cut by ranges of the tie column.
    assert max(r["count"] for r in sizes) < 100
    assert cut.where("not _hot").select("_slice").distinct().count() == 1


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_cuts_do_not_depend_on_arrival(spark, kind):
    """Whatever order rows are read and merged in, a row gets the same slice; outliers spoil no cut."""
    df = sample(spark, 5, 900)
    far = spark.createDataFrame([("hot", -(10**9), -1, 1), ("hot", 10**9, -2, 1)], df.schema)
    df = df.unionAll(far).withColumn("t", F.timestamp_seconds("t") if kind == "timestamp" else F.col("t").cast(kind))
    slicing = ordered.Slicing(hot_rows=50, parts=8, tie_rows=40)
    found = set()
    for parts, order in ((1, F.col("i")), (7, F.col("i").desc()), (5, F.rand(3)), (3, F.rand(4))):
        mixed = df.repartition(parts, F.rand(parts)).sortWithinPartitions(order)
        cut = ordered.sliced(mixed, ["k"], "t", ["i"], slicing).select("i", "t", "k", "_slice", "_sub", "_hot")
        found.add(tuple(sorted(map(tuple, cut.collect()), key=str)))
    assert len(found) == 1
    rows = sorted((r for r in next(iter(found)) if r[2] == "hot"), key=lambda r: (r[1], r[0]))
    assert [r[3:5] for r in rows] == sorted(r[3:5] for r in rows)
    assert len({r[3] for r in rows}) > 6


@pytest.mark.parametrize("slicing", SLICINGS)
@pytest.mark.parametrize("exclusive", [False, True])
def test_percentiles(spark, slicing, exclusive):
    import statistics

    rng = random.Random(7)
    data = {"a": [rng.random() for _ in range(200)], "b": [5.0] * 90 + [1.0, 9.0], "c": [3.0], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, x double")
    got = stats.percentiles(df, ["k"], "x", {"p95": 95, "p50": 50}, exclusive, slicing)
    for row in got.collect():
        xs = sorted(data[row.k])
        if exclusive:
            q = statistics.quantiles(xs, n=100) if len(xs) > 1 else [xs[0]] * 99
            want = q[94], q[49]
        else:
            def at(p, xs=xs):
                i = p / 100 * (len(xs) - 1)
                low = int(i)
                high = min(low + 1, len(xs) - 1)
                return xs[low] * (1 - (i - low)) + xs[high] * (i - low)

            want = at(95), at(50)
        assert (row.p95, row.p50) == pytest.approx(want)


@pytest.mark.parametrize("slicing", SLICINGS)
def test_failure_runs(spark, slicing):
    rng = random.Random(11)
    seq = [(k, i, rng.random() < 0.75) for k in ("x", "y") for i in range(150)]
    df = spark.createDataFrame(seq, "k string, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = slo.failure_runs(df, ["k"], "ts", F.col("bad"), ties=("s",), slicing=slicing).select(
        "k", "failures", *(F.unix_seconds(c) for c in ("started_at", "opened_at", "last_failure_at", "half_open_at"))
    )
    want = []
    for key in ("x", "y"):
        run = []
        for k, i, bad in [*[s for s in seq if s[0] == key], (key, -1, False)]:
            if bad:
                run.append(i)
            else:
                if len(run) >= 5:
                    want.append((k, len(run), run[0], run[4], run[-1], run[-1] + 30))
                run = []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def model_drop(events, limit, width):
    used, out = {}, {}
    for i, key, when in sorted(events, key=lambda e: (e[2], e[0])):
        slot = (key, when // width)
        out[i] = used.get(slot, 0) < limit
        used[slot] = used.get(slot, 0) + out[i]
    return out


def model_schedule(events, limit, width):
    state, out = {}, {}
    for i, key, when in sorted(events, key=lambda e: (e[2], e[0])):
        window, used = state.get(key, (-1, 0))
        w = max(when // width, window)
        used = used if w == window else 0
        if used >= limit:
            w, used = w + 1, 0
        state[key] = (w, used + 1)
        out[i] = w
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quota_against_a_model(spark, seed):
    rng = random.Random(seed)
    limit, width = rng.choice([1, 2, 5]), rng.choice([7, 20])
    events = [
        (i, "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(rng.choice([40, 200]))) for i in range(250)
    ]
    df = spark.createDataFrame(events, "i long, service_name string, s long").withColumn("ts", F.timestamp_seconds("s"))
    slicing = SLICINGS[seed % 3]
    drop = quota.apply_quota(
        df, arrival="ts", window_seconds=width, tenant=None, source_limit=limit, ties=("i",), slicing=slicing
    )
    assert {r.i: r.allowed for r in drop.collect()} == model_drop(events, limit, width)
    plan = quota.release_schedule(
        df, identity="service_name", limit=F.lit(limit), arrival="ts", window_seconds=width, ties=("i",), slicing=slicing
    ).select("i", (F.unix_seconds("release_window") / width).cast("long").alias("w"), "delay_windows")
    rows = plan.collect()
    assert {r.i: r.w for r in rows} == model_schedule(events, limit, width)
    assert len(rows) == len(events) and all(r.delay_windows >= 0 for r in rows)


def test_source_limit_zero_leaves_the_tenant_stage(spark):
    df = spark.createDataFrame([(1, "s", "tenant-a"), (2, "s", "tenant-a"), (3, "s", None)], "i long, service_name string, tenant_id string")
    df = df.withColumn("ts", F.timestamp_seconds("i"))
    rows = quota.apply_quota(
        df, arrival="ts", window_seconds=60, tenant_overrides={"tenant-a": 1}, ties=("i",)
    ).orderBy("i").collect()
    assert [(r.allowed, r.dimension) for r in rows] == [(True, None), (False, "tenant"), (True, None)]


def test_as_of_ties_and_deletes(spark):
    facts = spark.createDataFrame(
        [(1, "c", "r", 10, 0, 1, "t", "1"), (1, "c", "r", 10, 0, 2, "t", None), (1, "c", "q", 5, 0, 3, "t", "7")],
        "table_id long, column_name string, row_identity string, s long, partition int, offset long, topic string, new_value string",
    ).withColumn("changed_at", F.timestamp_seconds("s"))
    lookups = spark.createDataFrame(
        [(1, "c", "r", 9), (1, "c", "r", 10), (1, "c", "q", 99), (2, "c", "r", 9)],
        "table_id long, column_name string, row_identity string, s long",
    ).withColumn("at", F.timestamp_seconds("s")).drop("s")
    got = changes.values_at(facts, lookups).collect()
    found = {(r.table_id, r.row_identity, int(r["at"].timestamp())): (r.value, r.found) for r in got}
    assert sorted(found.values(), key=str) == sorted([(None, False), (None, True), ("7", True), (None, False)], key=str)


@pytest.mark.parametrize("margins", [(0.01, 0.1, 1.0), (0.0, 0.0001, 1.0), (1.0,)])
def test_selection_is_exact_whatever_the_sketch_says(spark, monkeypatch, margins):
    """Brackets that are too narrow are noticed; NaN comes last, nulls don't count, ties are kept apart by rank."""
    from changetide.operators import selection

    monkeypatch.setattr(selection, "MARGINS", margins)
    monkeypatch.setattr(selection, "SKETCH", 8)
    rng = random.Random(3)
    data = {
        "wide": [rng.gauss(0, 1e6) for _ in range(3000)],
        "ties": [float(rng.randrange(5)) for _ in range(2000)],
        None: [rng.random() for _ in range(500)] + [float("nan")] * 40 + [float("inf"), float("-inf")],
        "nan": [float("nan")] * 60,
        "few": [3.0, 1.0, None],
    }
    rows = [(k, x) for k, xs in data.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = stats.percentiles(df, ["k"], "x", {"p0": 0, "p50": 50, "p99": 99, "p100": 100}, slicing=ordered.Slicing(50, 4, 1000))
    found = {r.k: (r.p0, r.p50, r.p99, r.p100) for r in got.collect()}
    assert set(found) == set(data)
    for k, xs in data.items():
        xs = sorted((x for x in xs if x is not None), key=lambda x: (x != x, x))
        for p, value in zip((0, 50, 99, 100), found[k]):
            place = p * (len(xs) - 1) / 100
            low, high = xs[int(place)], xs[min(int(place) + 1, len(xs) - 1)]
            want = low * (1 - place % 1) + high * (place % 1)
            assert value == pytest.approx(want, nan_ok=True), (k, p)


def test_selection_reads_integers_and_decimals(spark):
    df = spark.range(1001).select(F.lit(1).alias("k"), F.col("id").alias("x"), (F.col("id") / 8).cast("decimal(10,3)").alias("d"))
    small = ordered.Slicing(50, 4, 1000)
    assert stats.percentiles(df, ["k"], "x", {"p": 25}, slicing=small).head().p == 250
    assert float(stats.percentiles(df, ["k"], "d", {"p": 25}, slicing=small).head().p) == 31.25
    assert stats.percentiles(df.limit(0), ["k"], "x", {"p": 25}, slicing=small).count() == 0


def test_runs_of_positions(spark):
    from changetide.operators import runs

    rng = random.Random(9)
    borders = [runs.BLOCK, runs.SPAN, 3 * runs.SPAN]
    offsets = {rng.randrange(300) for _ in range(200)} | {b + i for b in borders for i in range(-20, 20) if i % 7}
    rows = [(t, p, o) for t in "ab" for p in (0, 1) for o in offsets if (o + p) % 11] * 2
    rows += [("a", None, 3), (None, 0, 3), ("a", 0, None)]
    frame = spark.createDataFrame(rows, "topic string, partition int, offset long").repartition(5)
    found = runs.runs_of(frame).collect()
    held = [(r.topic, r.partition, o) for r in found for o in range(r.first_offset, r.last_offset + 1)]
    assert sorted(held) == sorted(set(rows[:-3]))
    assert all(r.first_offset // runs.SPAN == r.last_offset // runs.SPAN == r.span for r in found)
    ends = {(r.topic, r.partition, r.span, r.last_offset + 1) for r in found}
    assert not ends & {(r.topic, r.partition, r.span, r.first_offset) for r in found}
    known = frame.where("offset % 3 = 0")
    fresh = runs.new_positions(frame, runs.merged_runs(runs.runs_of(known).unionAll(runs.runs_of(known.where("offset < 200")))))
    got = sorted(map(str, ((r.topic, r.partition, r.offset) for r in fresh.collect())))
    assert got == sorted(map(str, [r for r in set(rows[:-3]) if r[2] % 3] + rows[-3:]))
    gaps = {(r.topic, r.partition, o) for r in runs.missing_runs(runs.runs_of(frame)).where("last_offset < 300").collect() for o in range(r.first_offset, r.last_offset + 1)}
    low = {(t, p): [o for a, b, o in set(rows[:-3]) if (a, b) == (t, p)] for t in "ab" for p in (0, 1)}
    assert gaps == {(t, p, o) for (t, p), os in low.items() for o in range(min(os), 300) if o not in set(os)} - {
        (t, p, o) for (t, p), os in low.items() for o in range(max([x for x in os if x < 300]) + 1, 300)
    }
    assert runs.runs_of(frame.limit(0)).count() == 0


@pytest.mark.parametrize("slicing", SLICINGS[:2])
def test_validity_against_a_model(spark, slicing):
    """Late batches, ties by position, repeated changes and a key with most of the changes."""
    from datetime import datetime, timezone

    from changetide.operators import validity

    rng = random.Random(12)
    rows = [
        (1, "c", "hot" if rng.random() < 0.6 else rng.choice("ab"), rng.randrange(60), 0, i, "t", rng.choice(["x", "y", None]))
        for i in range(240)
    ]
    rows += [(1, "c", None, 5, 0, 900, "t", "z"), (1, "c", "a", None, 0, 901, "t", "z")]
    schema = "table_id long, column_name string, row_identity string, s long, partition int, offset long, topic string, new_value string"
    facts = spark.createDataFrame(rows, schema).withColumn("changed_at", F.timestamp_seconds("s"))
    whole = validity.intervals(facts, slicing=slicing)
    parts = [validity.intervals(facts.where(F.col("offset") % 3 == i), slicing=slicing) for i in (2, 0, 1)]
    pieced = validity.merged(validity.merged(parts[0], parts[1], slicing=slicing), parts[2], slicing=slicing)
    listed = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert listed(whole) == listed(pieced)
    known = [r for r in rows if r[2] is not None and r[3] is not None]
    for second in (0, 7, 59, 1000):
        at = datetime.fromtimestamp(second, tz=timezone.utc)
        got = {r.row_identity: (r.new_value, r.offset) for r in validity.snapshot(whole, at).collect()}
        want = {}
        for r in sorted((r for r in known if r[3] <= second), key=lambda r: (r[3], r[5])):
            want[r[2]] = (r[7], r[5])
        assert got == want
    lookups = facts.select("table_id", "column_name", "row_identity", F.timestamp_seconds(F.col("s") + 1).alias("at")).dropna()
    asked = validity.values_at(whole, lookups)
    assert listed(asked) == listed(changes.values_at(facts.where("row_identity is not null and s is not null"), lookups, slicing=slicing))
    assert validity.intervals(facts.limit(0)).count() == 0
