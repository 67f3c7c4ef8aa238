import base64
import glob
import json
import os
from datetime import datetime, timezone

import pytest
from conftest import at
from pyspark.sql import functions as F

from changetide import schemas
from changetide.functions import deep, present, signing, values
from changetide.operators import catalog, deadletter, feed, health, retention, search
from changetide.session import checkpoint_dir
from changetide.sources import broker, files, manifest

UTC = timezone.utc


def stored(spark, path):
    rows = [(i, datetime(2024, 1 + i % 4, 1 + i, tzinfo=UTC)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, capture_time timestamp")
    files.write_table(df, path, "capture_time")
    return files.read_table(spark, path)


def test_boundary_month_is_rewritten_and_archived(spark, tmp_path):
    path, archive = f"{tmp_path}/t", f"{tmp_path}/archive"
    stored(spark, path)
    now = datetime(2024, 3, 12, tzinfo=UTC)
    policy = retention.Policy("t", "capture_time", 5)
    retention.expire_boundary(spark, path, policy, now, f"{tmp_path}/stage", archive)
    kept = {r.id for r in files.read_table(spark, path).collect()}
    # March holds ids 2, 6 and 10 on days 3, 7 and 11; only day 3 is before the 7th.
    assert kept == set(range(12)) - {2}
    lines = [json.loads(x) for f in glob.glob(f"{archive}/archive_date=20240312/*.txt") for x in open(f)]
    assert [x["id"] for x in lines] == [2]


def test_whole_months_are_dropped(spark, tmp_path):
    path, archive = f"{tmp_path}/t", f"{tmp_path}/archive"
    stored(spark, path)
    dropped = retention.drop_months(spark, path, datetime(2024, 3, 1, tzinfo=UTC), archive)
    assert dropped == ["202401", "202402"]
    assert files.read_table(spark, path).count() == 6
    assert sum(1 for f in glob.glob(f"{archive}/*/*.txt") for _ in open(f)) == 6
    assert not os.path.exists(f"{path}/month=202401")


def test_policy_off_and_extra_condition(spark):
    df = spark.createDataFrame([(at(0), True), (at(0), False), (None, True)], "replayed_at timestamp, replayed boolean")
    spill = retention.Policy("api_audit_log_spill", "replayed_at", 1, "replayed")
    assert retention.expired_rows(df, spill, at(10**6)).count() == 1
    assert retention.kept_rows(df, spill, at(10**6)).count() == 2
    off = retention.Policy("x", "replayed_at", 0)
    assert retention.expired_rows(df, off, at(10**6)).count() == 0


def test_broker_options():
    assert broker.subscribe_options("k:9092", ["a.b", "c"], 100) == {
        "kafka.bootstrap.servers": "k:9092", "subscribe": "a.b,c", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "100",
    }
    assert json.loads(broker.assign_options("k", {"t": [2, 0]})["assign"]) == {"t": [0, 2]}
    assert broker.cluster_options({"bootstrap_servers": ["a", "b"], "topics": ["t"]})["kafka.bootstrap.servers"] == "a,b"
    assert "assign" in broker.cluster_options({"bootstrap_servers": "a", "partitions": {"t": [1]}})
    assert broker.topic_sink_options("k", "dlq")["includeHeaders"] == "true"


def test_clusters_are_united(spark, monkeypatch):
    monkeypatch.setattr(broker, "read_topics", lambda s, o, stream: s.createDataFrame([(o["subscribe"],)], "topic string"))
    both = broker.read_clusters(
        spark, {"east": {"bootstrap_servers": "a", "topics": ["t"]}, "west": {"bootstrap_servers": "b", "topics": ["u"]}}, False
    )
    assert sorted(map(tuple, both.collect())) == [("t", "east"), ("u", "west")]


def test_queue_files(spark, tmp_path):
    rows = [("q", 44, at(0), '{"op":"c"}'), ("q", 45, at(1), '{"op":"u"}')]
    spark.createDataFrame(rows, schemas.QUEUE_MESSAGE).write.json(f"{tmp_path}/q")
    messages = files.read_queue(spark, f"{tmp_path}/q")
    assert sorted(r.offset for r in messages.collect()) == [44, 45]
    points = health.checkpoints(
        messages.withColumn("event_time", F.col("timestamp")), "g", "rabbitmq"
    ).head()
    assert (points.broker_substream, points.broker_position, points.kafka_topic) == ("", "45", None)


def test_checkpoints_compare_numbers(spark):
    rows = [("t", 0, 9), ("t", 0, 12), ("t", 0, 10), ("t", 1, 5), ("t", None, 7)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long").withColumn("event_time", F.timestamp_seconds("offset"))
    got = {(r.broker_substream, r.broker_position) for r in health.checkpoints(df, "g").collect()}
    assert got == {("0", "12"), ("1", "5")}


def test_manifest(spark, tmp_path):
    document = {
        "connectors": [
            {"source_name": "b", "database_hostname": "h", "tables": ["s.t", "s.u", 5]},
            {"source_name": "a", "database_hostname": "h", "tables": ["s.t"], "enabled": False},
            {"source_name": "b", "database_hostname": "h", "tables": ["s.t"], "enabled": True},
            {"source_name": "no good", "tables": "x", "color": 1, "enabled": "yes", "slot_name": 3, "config_overrides": []},
            7,
        ],
        "extra": 1,
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps(document))
    docs = manifest.read_manifest(spark, str(path))
    entries = manifest.connectors(docs)
    assert [r.topic for r in manifest.subscribed_topics(entries).collect()] == ["b.s.t", "b.s.u"]
    assert [r.violation for r in manifest.root_violations(docs).collect()] == ["Unknown root fields: extra"]
    broken = sorted(r.violation for r in manifest.violations(entries).collect())
    assert broken == sorted(
        [
            "connectors[0].tables[2] must match ^[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_-]+$",
            "connectors[3] missing required fields: database_hostname",
            "connectors[3] has unknown fields: color",
            "connectors[3].source_name must match ^[a-zA-Z0-9_-]+$",
            "connectors[3].database_hostname must be a non-empty string",
            "connectors[3].tables must be a non-empty array",
            "connectors[3].enabled must be a boolean",
            "connectors[3].slot_name must be a string",
            "connectors[3].config_overrides must be an object",
            "connectors[4] must be an object.",
        ]
    )


def test_paging(spark):
    df = spark.createDataFrame([(at(i // 3), i) for i in range(20)], "capture_time timestamp, offset long")
    seen, cursor = [], None
    while True:
        page = (
            search.newest_first(df, position=("offset",), limit=6)
            if cursor is None
            else search.keyset_page(df, cursor, position=("offset",), limit=6)
        ).collect()
        seen += [r.offset for r in page]
        cursor = search.next_cursor(page, 6, position=("offset",))
        if cursor is None:
            break
    assert seen == list(range(19, -1, -1))
    with pytest.raises(ValueError):
        search.newest_first(df, position=("offset",), limit=1001)


def test_cursors_survive_their_text(spark):
    rows = [(at(i // 4), i, i % 3, f"t{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "capture_time timestamp, offset long, partition int, topic string")
    seen, cursor = [], None
    while True:
        page = search.page_with_total(df, cursor, limit=7).collect()
        assert {r.total for r in page} == ({40} if cursor is None else {None})
        seen += [r.offset for r in page]
        after = search.next_cursor(page, 7)
        if after is None:
            break
        cursor = search.read_cursor(search.cursor_text(after))
    assert seen == list(range(39, -1, -1))
    forced = search.page_with_total(df, cursor, include_total=True, limit=7).collect()
    assert {r.total for r in forced} == {40}
    for bad in ("[]", "x", "{}", '{"time": "2024-01-01", "offset": 1}', '{"time": "noon", "offset": 1, "partition": 1, "topic": "t"}'):
        with pytest.raises(ValueError):
            search.read_cursor(bad)


def test_arguments():
    assert search.table_reference(" db.s.t ") == ("db", "s.t")
    assert search.table_reference("t", "db") == ("db", "t")
    for bad in ("t", ".t", "db."):
        with pytest.raises(ValueError):
            search.table_reference(bad)


def test_tenant_scope_rejections(spark):
    df = spark.createDataFrame([("a",), ("b",)], "service_name string")
    assert search.tenant_scope(df, None, admin=True).count() == 2
    assert search.tenant_scope(df, None, "b", admin=True).count() == 1
    assert search.tenant_scope(df, "a").count() == 1
    with pytest.raises(PermissionError):
        search.tenant_scope(df, None)
    with pytest.raises(PermissionError):
        search.tenant_scope(df, "a", "b")


def test_hmac(spark):
    import hashlib
    import hmac

    for secret in ("s", "k" * 100, "schlüssel"):
        found = spark.range(1).select(signing.hmac_sha256(F.lit('{"ä":1}'), secret)).head()[0]
        assert found == hmac.new(secret.encode(), '{"ä":1}'.encode(), hashlib.sha256).hexdigest()


def test_decimals(spark):
    def doc(number, scale, width):
        return json.dumps({"scale": scale, "value": base64.b64encode(number.to_bytes(width, "big", signed=True)).decode()})

    cases = [(123, 2, 1), (-123, 2, 2), (5, 3, 1), (-5, 0, 1), (12, -2, 1), (0, 2, 1), (2**63 - 1, 0, 8), (-(2**63), 4, 8), (-(2**100), 5, 13)]
    want = ["1.23", "-1.23", "0.005", "-5", "1200", "0.00", str(2**63 - 1)]
    rows = spark.createDataFrame([(doc(*c),) for c in cases] + [('{"scale":1,"value":""}',), ('{"a":1}',), ("5",)], "j string")
    got = rows.select(present.decimal_text(values.parse_json(F.col("j"))), deep.decode_decimal(F.col("j"))).collect()
    assert [r[0] for r in got][:7] == want
    # JVM expression and Arrow function agree.
    assert [r[0] for r in got] == [r[1] for r in got]
    assert [r[0] for r in got][-3:] == ["0", None, None]


def test_deep_normalisation(spark):
    doc = '{"a":[{"created_at":1700000000,"n":1}],"t":{"update_time":1700000000000000},"x":1.50,"flag_at":true}'
    out = spark.createDataFrame([(doc,)], "j string").select(deep.normalise_json(F.col("j"))).head()[0]
    assert json.loads(out) == {
        "a": [{"created_at": "2023-11-14T22:13:20+00:00", "n": 1}], "t": {"update_time": "2023-11-14T22:13:20+00:00"},
        "x": 1.5, "flag_at": True,
    }
    assert '"x":1.50' in out


def test_time_label_and_truncation(spark):
    row = spark.range(1).select(
        present.time_label(F.lit(at(0)), F.lit(at(90))),
        present.time_label(F.lit(at(0)), F.lit(at(-7200)), compact=True),
        present.time_label(F.lit(None).cast("timestamp"), F.lit(at(0))),
        present.truncated(F.lit("x" * 70)),
    ).head()
    assert row[0] == "2023-11-14T22:13:20+00:00 (1m ago)"
    assert row[1] == "22:13:20 (in 2h)"
    assert row[2] == "unknown"
    assert row[3] == "x" * 63 + "..."


def test_dead_letter_marks_beat_the_failure_of_the_same_instant(spark):
    base = ("s", "kafka", "t", "0", "1", "t", 0, 1, "UPDATE", "{}", "boom", at(0))
    log = spark.createDataFrame([(*base, False, None, None), (*base, True, at(0), None)], schemas.DEAD_LETTERS)
    assert deadletter.latest_dead_letters(log).head().is_replayed


def test_health_rows(spark):
    schema = (
        "cluster string, running boolean, connected boolean, reconnecting boolean, topics array<string>, last_error string, "
        "last_message_at timestamp, last_commit_at timestamp, lag_total long, dlq_messages long, breaker_state string"
    )
    def verdict(**changes):
        base = dict(cluster="a", running=True, connected=True, reconnecting=False, topics=["t"], last_error=None,
                    last_message_at=at(0), last_commit_at=at(0), lag_total=0, dlq_messages=0, breaker_state="closed")
        frame = spark.createDataFrame([tuple({**base, **changes}.values())], schema)
        return health.readiness(health.health_rollup(frame, F.lit(at(10)))).head()

    assert verdict().ready and verdict().status == "healthy"
    assert not verdict(connected=False).ready
    assert not verdict(lag_total=1001).ready
    assert not verdict(dlq_messages=1).ready
    assert not verdict(last_commit_at=at(-1000)).ready
    assert not verdict(last_commit_at=None, lag_total=1).ready
    assert verdict(last_commit_at=None).ready
    assert verdict(breaker_state="half-open").breaker_state == "half-open"


def test_fan_out_reaches_everybody(spark):
    feed_rows = spark.createDataFrame([("t", 0, i, "ab"[i % 2]) for i in range(50)], "topic string, partition int, offset long, service_name string")
    subs = spark.createDataFrame([("all", None), ("one", "a"), ("none", "z")], "subscriber string, tenant string")
    got = {r.subscriber: r["count"] for r in feed.fan_out(feed_rows, subs).groupBy("subscriber").count().collect()}
    assert got == {"all": 50, "one": 25}


def test_upsert_keeps_what_a_person_set(spark):
    columns = "table_id long, column_id long, column_name string, data_type string, is_primary_key boolean, is_nullable boolean, audit_enabled boolean"
    old = spark.createDataFrame([(1, 10, "a", "x", False, False, False)], columns)
    new = spark.createDataFrame([(1, 99, "a", "y", True, True, True), (1, 11, "b", "z", False, True, True)], columns)
    got = {r.column_name: tuple(r) for r in catalog.upsert_columns(old, new).collect()}
    assert got["a"] == (1, 10, "a", "y", True, True, False) and got["b"][1] == 11


def test_shared_checkpoint_folder(spark, monkeypatch):
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark, "/fallback") == (given or "/fallback")

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value

    class Session:
        conf = Conf("/shared")

    assert checkpoint_dir(Session(), "/fallback") == "/shared"
    Session.conf = Conf(None)
    assert checkpoint_dir(Session(), "/fallback") == "/fallback"
    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_merging_by_key_leaves_the_stored_side_in_place(spark, tmp_path):
    from changetide.sources import keyed

    name = f"{keyed.database(spark, str(tmp_path))}.t"
    make = lambda rows: spark.createDataFrame(rows, "k long, j string, v int, t long")
    keep = lambda old, new: keyed.newest(old, new, ("k", "j"), ("t",))
    keyed.merge(spark, name, make([(i, "a", 0, 10) for i in range(50)]), ("k", "j"), 8, keep)
    batch = make([(1, "a", 1, 11), (2, "a", 1, 9), (3, "a", 1, 10), (99, "b", 1, 0)])
    plan = keyed.merged(spark, name, batch, keep)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    keyed.merge(spark, name, batch, ("k", "j"), 8, keep)
    got = {(r.k, r.j): (r.v, r.t) for r in spark.table(name).collect()}
    assert len(got) == 51 and got[1, "a"] == (1, 11) and got[2, "a"] == (0, 10) and got[3, "a"] == (1, 10)
    assert got[99, "b"] == (1, 0) and spark.table(name).columns == ["k", "j", "v", "t"]
    spark.sql(f"DROP DATABASE {name.split('.')[0]} CASCADE")


def test_retention_passes_over_unfinished_batches(spark, tmp_path, landed):
    from datetime import timedelta

    from conftest import flat

    from changetide.streaming import ingestion, tables

    root = f"{tmp_path}/tables"
    rows = [("o.s", 0, i, flat("c", after={"id": i}, ts_ms=1_700_000_000_000 + i * 10 * 86_400_000)) for i in range(12)]
    ingestion.store_batch(root)(landed(rows), 0)
    broken = tables.read_log(spark, root, "events").withColumn("topic", F.lit("broken"))
    tables.begin(spark, root, 1)
    tables.write_batch(broken, root, "events", 1)  # and there it broke off
    assert tables.read_log(spark, root, "events").count() == 12
    visible = lambda: tables.read_log(spark, root, "events").drop("seq")
    now = datetime(2024, 1, 20, tzinfo=UTC)
    policy = retention.Policy("events", "capture_time", 10)
    before = visible().where(F.col("capture_time") < F.lit(now - timedelta(days=10))).count()
    archive = f"{tmp_path}/archive"
    retention.drop_months(spark, f"{root}/events", datetime(2024, 1, 1, tzinfo=UTC), archive, now, visible())
    retention.expire_boundary(spark, f"{root}/events", policy, now, f"{tmp_path}/stage", archive, visible())
    assert 0 < before < 12 and tables.read_log(spark, root, "events").count() == 12 - before
    lines = [json.loads(x) for f in glob.glob(f"{archive}/*/*.txt") for x in open(f)]
    assert len(lines) == before and {x["topic"] for x in lines} == {"o.s"}
    tables.publish(spark, root, 1)  # had it gone on, nothing of it would be missing
    assert tables.read_log(spark, root, "events").where("topic = 'broken'").count() == 12


def test_folding_and_removing_batches(spark, tmp_path, landed):
    from conftest import flat

    from changetide.streaming import ingestion, tables

    root = f"{tmp_path}/tables"
    store = ingestion.store_batch(root)
    for batch in range(2):
        store(landed([("o.s", 0, i, flat("c", after={"id": i})) for i in range(batch * 5, batch * 5 + 5)]), batch)
    for name in ("events", "positions", "monitored_columns", "ingestion_counters"):
        before = tables.read_log(spark, root, name).drop("batch_id", "seq")
        tables.compact(spark, root, name)
        assert tables.read_log(spark, root, name).select("batch_id").distinct().count() == 1
        assert name != "events" or sorted(map(str, before.collect())) == sorted(
            map(str, tables.read_log(spark, root, name).drop("batch_id", "seq").collect())
        )
        tables.vacuum(spark, root, name)
        tables.compact(spark, root, name)  # nothing to fold
    runs = tables.read_log(spark, root, "positions").collect()
    assert [(r.first_offset, r.last_offset) for r in runs] == [(0, 9)]
    assert not tables.begin(spark, root, 0)  # folded, hence complete
    store(landed([("o.s", 0, i, flat("c", after={"id": i})) for i in range(8, 12)]), 2)
    assert tables.read_log(spark, root, "events").count() == 12
    counted = tables.counters(spark, root).head()
    assert (counted.consumed, counted.processed, counted.duplicate, counted.failed) == (14, 12, 2, 0)
