"""What must not grow with the rows: the side of a join that is sent out, work done twice, rows of a task."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from changetide.functions import parsing, values
from changetide.operators import catalog, changes, ingest
from changetide.plans import graph
from changetide.sources import files
from changetide.streaming import ingestion, tables
from tests.conftest import flat
from workload import lookup, samples


def _events(landed, n=40):
    rows = [("orderdb.public.orders", 0, i, flat("u", {"id": i, "a": 1}, {"id": i, "a": i})) for i in range(n)]
    return ingest.with_row_identity(ingest.parse_messages(landed(rows)))


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _table(spark, landed, tmp_path):
    """Events whose files tell Spark a size that the estimate of parsed rows falls far below."""
    _events(landed).write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events"))


def test_changes_are_never_the_side_that_is_broadcast(spark, landed, tmp_path):
    events = _table(spark, landed, tmp_path)
    found = changes.column_changes(events, catalog.discover_columns(events))
    assert "BuildRight" in _plan(found) and "BuildLeft" not in _plan(found)
    assert found.count() == 39  # a = 1 stays 1 once


def test_named_changes_are_never_the_side_that_is_broadcast(spark, landed, tmp_path):
    events = _table(spark, landed, tmp_path)
    columns = catalog.discover_columns(events)
    stored = changes.column_deltas(events).withColumn("column_id", F.xxhash64("table_id", "column_name"))
    named = changes.name_columns(stored, columns)
    assert "BuildRight" in _plan(named) and "BuildLeft" not in _plan(named)
    assert {r.column_name for r in named.collect()} == {"a"}


def test_a_document_is_printed_once_for_its_masks(spark, landed, tmp_path):
    masked = ingest.mask_fields(_table(spark, landed, tmp_path), ("password", "token"), as_received=True)
    plan = masked.select("event_data")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1


def test_a_row_is_filtered_once_for_its_identity(spark, landed, tmp_path):
    identified = ingest.with_row_identity(_table(spark, landed, tmp_path))
    plan = identified.select("offset", "row_identity")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_filter") == 1
    assert {r.row_identity for r in identified.collect()} == {f'{{"id":{i}}}' for i in range(40)}
    events = ingest.parse_messages(landed([("d.p.t", 0, i, flat("u", b, a)) for i, (b, a) in enumerate([
        ({"id": 1}, None), ({"id": 1}, {"id": None}), ({"a": 1}, {"a": 2}), (None, None), ({"id": 1}, {"Uid": 2, "x": 0})])]))
    found = {r.offset: r.row_identity for r in ingest.with_row_identity(events).collect()}
    assert found == {0: '{"id":1}', 1: None, 2: None, 3: None, 4: '{"Uid":2}'}


def test_tasks_grow_with_rows_whatever_the_splits(spark, tmp_path):
    spark.range(5_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = files.spread(spark.read.parquet(str(tmp_path / "t")), task_rows=250)
    assert spread.rdd.getNumPartitions() == 20
    assert max(spread.rdd.glom().map(len).collect()) < 500 and spread.count() == 5_000


def test_a_stored_table_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1_000).select("id", F.timestamp_seconds(F.col("id") * 10_000).alias("at"))
    path = str(tmp_path / "t")
    files.write_table(rows.mapInPandas(look, rows.schema), path, "at")
    assert seen.value == 1_000
    assert files.read_table(spark, path).count() == 1_000
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_changes_tell_of_the_event_that_was_stored(spark, landed, tmp_path, monkeypatch):
    """Of two documents at one position, event and changes come from the same; positions are searched once."""
    root, read, audited = str(tmp_path / "tables"), [], graph.audited_changes
    monkeypatch.setattr(graph, "audited_changes", lambda e, c: read.extend(e.inputFiles()) or audited(e, c))
    rows = [("orderdb.public.orders", 0, i, flat("u", {"id": i, "a": "x"}, {"id": i, "a": v})) for i in range(30) for v in ("y", "z")]
    ingestion.store_batch(root)(landed(rows).repartition(7), 0)
    event = F.try_variant_get("event_data", "$.after.a", "string").alias("a")
    stored = {r.offset: r.a for r in tables.read_log(spark, root, "events").select("offset", event).collect()}
    changed = {r.offset: r.new_value.strip('"') for r in tables.read_log(spark, root, "column_changes").collect()}
    assert len(stored) == 30 and changed == stored
    assert read and all("/tables/events/" in name for name in read)


def _landed_events(spark, tmp_path, n=300):
    kinds = F.element_at(F.array(*map(F.lit, ("click", "view"))), (F.col("id") % 2 + 1).cast("int"))
    rows = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 9).alias("user_id"),
        kinds.alias("event_type"),
        (F.col("id") / 4).alias("value"),
        F.format_string('{"k": %d}', "id").alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_a_scan_prints_no_documents(spark, tmp_path):
    """One row group is read by one task; documents are made behind the exchange, whoever filters on them."""
    found = ingest.skip_tombstones(samples.messages(spark, _landed_events(spark, tmp_path)))
    above, below = _plan(found).split("Exchange", 1)
    assert "StructsToJson" in above and "StructsToJson" not in below and "get_json_object" not in below
    assert found.count() == 300 - 3


def test_dealing_out_rows_sorts_none(spark, tmp_path):
    spark.range(500).union(spark.range(500)).union(spark.range(5).select(F.lit(None).cast("long"))).coalesce(1).write.parquet(
        str(tmp_path / "t")
    )
    spread = files.spread(spark.read.parquet(str(tmp_path / "t")), task_rows=50)
    assert "RoundRobin" not in _plan(spread) and spread.columns == ["id"]
    assert spread.count() == 1_005 and spread.where("id is null").count() == 5


def test_a_batch_is_read_once_for_its_catalog(spark, landed, tmp_path):
    events = _table(spark, landed, tmp_path)
    known = catalog.discover_columns(events).where("column_name = 'a'").withColumns(
        {"audit_enabled": F.lit(False), "column_id": F.lit(7).cast("long")}
    )
    spark.createDataFrame(known.collect(), known.schema).write.parquet(str(tmp_path / "known"))
    old = spark.read.parquet(str(tmp_path / "known"))
    strange = old.withColumns({"column_name": F.lit("gone")})
    described, every = graph.catalog_columns(events, old.unionByName(strange))
    assert _plan(described).count("/events]") == 1 and _plan(every).count("/events]") == 1
    assert {(r.column_name, r.audit_enabled) for r in described.collect()} == {("id", True), ("a", False)}
    assert {(r.column_name, r.audit_enabled) for r in every.collect()} == {("id", True), ("a", False), ("gone", False)}
    tables_found = catalog.discover_tables(events)
    known_tables = spark.createDataFrame([r.asDict() | {"table_id": 5} for r in tables_found.collect()], tables_found.schema)
    merged = graph.catalog_tables(events, known_tables.unionByName(known_tables.withColumn("table_name", F.lit("other"))))
    assert _plan(merged).count("/events]") == 1
    assert [(r.table_id, r.table_name) for r in merged.collect()] == [(5, "public.orders")]


def test_members_that_most_documents_lack(spark):
    texts = ['{"payload":{"a":1},"k":"0"}', '{"payload":null}', '{"payload":[1]}', '{"k":0}', "[1]", "7", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    doc = values.parse_json(F.col("t"))
    rows = values.computed(rows, doc=doc)
    member = values.rare_member(F.col("doc"), "payload")
    given = values.given(values.text(F.col("doc"), "k"), F.col("doc"), "$.k")
    found = rows.select(
        F.to_json(member).alias("rare"), F.to_json(values.member(F.col("doc"), "payload")).alias("plain"),
        values.is_object(member).alias("object"), F.to_json(parsing.payload_of(F.col("doc"))).alias("payload"), given.alias("k"),
    ).collect()
    assert [r.rare for r in found] == [r.plain for r in found] == ['{"a":1}', "null", "[1]", None, None, None, None]
    assert [r.object for r in found] == [True] + 6 * [False]
    assert [r.payload for r in found] == ['{"a":1}'] + 6 * [None]
    assert [r.k for r in found] == ["0"] + 6 * [None]


def test_parse_and_discovery_follow_no_path_that_leads_nowhere(spark, landed, tmp_path):
    messages = landed([("t", 0, 1, flat("u", {"id": 1, "a": None}, {"id": 1, "a": "x"}))])
    plan = _plan(ingest.parse_messages(messages))
    assert "$.payload, struct" not in plan and "$.payload.source" not in plan
    columns = catalog.discover_columns(_table(spark, landed, tmp_path))
    assert "$.schema" not in _plan(columns) and "$.payload" not in _plan(columns)
    assert _plan(columns).count("schema_of_variant") <= 2


def test_documents_are_stored_in_one_piece(spark, landed, tmp_path):
    rows = [("t", 0, i, {"a": i, "b": "x"}) for i in range(50)]
    ingest.parse_messages(landed(rows)).write.parquet(str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("*.parquet"))
    assert files and not any("typed_value" in str(pq.read_schema(f).field("event_data").type) for f in files)


def test_inserted_events_parses_its_batch_once(spark, tmp_path):
    made = spark.range(40).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "1.5D AS value", "'{\"k\":1}' AS props"
    )
    made.write.parquet(str(tmp_path / "events.parquet"))
    found = lookup.queries["inserted_events"][0](spark, str(tmp_path))
    assert "parseJson" in _plan(samples.parsed(spark, str(tmp_path))) and "parseJson" not in _plan(found)
    assert {r.offset for r in found.collect()} == {i for i in range(40) if i % 4 and i % 103}
