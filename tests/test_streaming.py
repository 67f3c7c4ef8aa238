import json
from datetime import datetime, timezone

import pytest
from conftest import at, flat
from pyspark.sql import functions as F

from changetide import schemas
from changetide.sources import files
from changetide.streaming import ingestion, progress, tables

LANDED = schemas.LANDED_MESSAGE


def land(spark, path, rows):
    texts = [(t, p, o, at(o), v if isinstance(v, str) or v is None else json.dumps(v)) for t, p, o, v in rows]
    spark.createDataFrame(texts, LANDED).coalesce(1).write.mode("append").json(path)


def drain(spark, tmp, **options):
    stream = files.read_messages(spark, f"{tmp}/in", stream=True, max_files=1)
    query = ingestion.ingest_stream(stream, f"{tmp}/out", f"{tmp}/check", **options).start()
    query.awaitTermination()
    return query


def insert(i, **more):
    return ("orderdb.shop.orders", 0, i, flat("c", after={"id": i, "status": "new", **more}))


def test_restart_redelivery_and_new_columns(spark, tmp_path):
    tmp = str(tmp_path)
    land(spark, f"{tmp}/in", [insert(i) for i in range(3)])
    drain(spark, tmp, dedupe_horizon="1 day")
    root = f"{tmp}/out"
    assert tables.read_log(spark, root, "events").count() == 3
    assert tables.read_log(spark, root, "column_changes").count() == 6
    # After a restart the same positions come again, beside one new event with a new column.
    land(spark, f"{tmp}/in", [insert(i) for i in range(3)] + [insert(3, note="x")])
    drain(spark, tmp, dedupe_horizon="1 day")
    assert tables.read_log(spark, root, "events").count() == 4
    assert tables.read_log(spark, root, "column_changes").count() == 9
    names = [r.column_name for r in tables.current_columns(spark, root).orderBy("column_name").collect()]
    assert names == ["id", "note", "status"]
    assert tables.current_tables(spark, root).count() == 1


def test_a_repeated_batch_replaces_its_own_output(spark, tmp_path, landed):
    root = str(tmp_path)
    store = ingestion.store_batch(root)
    batch = landed([insert(i) for i in range(4)])
    for _ in range(2):
        store(batch, 7)
    assert tables.read_log(spark, root, "events").count() == 4
    assert tables.read_log(spark, root, "column_changes").count() == 8


def test_dead_letters_and_replay(spark, tmp_path, landed):
    root = str(tmp_path)
    rows = [insert(1), ("orderdb.shop.orders", 0, 2, {"op": "c", "ts_ms": 10**15}), ("t.x", 0, 3, b"\xff{}")]
    ingestion.store_batch(root)(landed(rows), 0)
    letters = tables.current_dead_letters(spark, root)
    assert {r.error_message for r in letters.collect()} == {"event time out of range", "invalid UTF-8"}
    now = datetime(2030, 1, 1, tzinfo=timezone.utc)
    outcome = ingestion.replay_dead_letters(spark, root, 1, now)
    # Bad bytes were stored as readable text, which is no JSON and hence filtered out.
    assert {(r.broker_position, r.status) for r in outcome.collect()} == {("2", "failed"), ("3", "skipped")}
    state = {r.broker_position: (r.is_replayed, r.replay_error) for r in tables.current_dead_letters(spark, root).collect()}
    assert state == {"2": (False, "event time out of range"), "3": (True, None)}


def test_failing_instead_of_dead_letters(spark, tmp_path, landed):
    store = ingestion.store_batch(str(tmp_path), on_error="fail")
    with pytest.raises(Exception, match="event time out of range"):
        store(landed([("t.x", 0, 1, {"ts_ms": 10**15})]), 0)


def test_windowed_counts_accept_late_rows(spark, tmp_path):
    schema = "event_time timestamp, service_name string, event_type string, operation string"
    path = f"{tmp_path}/in"
    for second in (5000, 10, 5010):
        row = [(at(second), "s", "c", "INSERT")]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").json(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    counts = ingestion.windowed_counts(stream, "1 hour", "1 day")
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("late_counts")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("late_counts").collect()) == [1, 2]


def test_progress_rows(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [insert(i) for i in range(5)])
    query = drain(spark, str(tmp_path))
    reports = [json.loads(p.json) for p in query.recentProgress]
    rows = [r for p in reports for r in progress.progress_rows(p)]
    assert sum(r[4] for r in rows) >= 5
    kafka = {"id": "q", "batchId": 1, "timestamp": "t", "sources": [
        {"description": "k", "numInputRows": 2, "endOffset": {"t": {"0": 5}}, "metrics": {"maxOffsetsBehindLatest": "9"}}]}
    assert progress.progress_rows(kafka)[0][-1] == 9
    log = progress.ProgressLog(spark, f"{tmp_path}/progress", every=2)
    for row in rows:
        log.add([row])
    assert log.frame().count() == len(rows)


def test_stored_months_prune(spark, tmp_path, landed):
    root = str(tmp_path)
    rows = [
        ("o.s", 0, i, flat("c", after={"id": i}, ts_ms=1_700_000_000_000 + i * 40 * 86_400_000)) for i in range(4)
    ]
    ingestion.store_batch(root)(landed(rows), 0)
    stored = tables.read_log(spark, root, "events")
    assert stored.select("month").distinct().count() == 4
    from changetide.operators import search

    late = search.search_events(stored, start=datetime(2024, 2, 1, tzinfo=timezone.utc))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("]")[0]
    assert late.agg(F.count(F.lit(1))).head()[0] == 2
