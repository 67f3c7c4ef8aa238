import json
from datetime import datetime, timezone

from conftest import flat
from pyspark.sql import functions as F

from changetide.functions import deep
from changetide.operators import catalog, changes, dedupe, ingest


def tag_station(events):
    """A step that reads what masking would hide later."""
    secret = F.try_variant_get("event_data", "$.reading.secret", "string")
    return events.withColumn("user_id", F.concat_ws("/", F.col("topic"), F.length(secret).cast("string")))


def look_only(events):
    return None


def test_steps_see_documents_before_they_are_masked(landed):
    document = {"reading": {"celsius": 21.5, "secret": "north-gate"}, "station": 7}
    messages = landed([("weather.probe", 3, 900, document)])
    row = ingest.prepare_events(messages, processors=[look_only, tag_station, look_only]).head()
    assert row.user_id == "weather.probe/10"
    assert row.event_data.toPython()["reading"]["secret"] == deep.MASK
    assert "north-gate" in row.raw_payload


def test_steps_by_name(landed):
    messages = landed([("weather.probe", 0, 1, {"reading": {"secret": "abc"}})])
    for name in ("test_pipeline:tag_station", "test_pipeline.tag_station"):
        assert ingest.prepare_events(messages, processors=[name]).head().user_id == "weather.probe/3"


def test_documents_without_masked_keys_are_left_alone(landed):
    odd = '{"a": 1e2, "to\\u006ben": "hidden", "b": [1.50]}'
    rows = landed([("w.p", 0, 1, odd), ("w.p", 0, 2, '{"a": 1.50,   "z": "token"}'), ("w.p", 0, 3, '{"x": {"token": [1]}}')])
    out = {r.offset: json.loads(r.j) for r in ingest.prepare_events(rows).select("offset", F.to_json("event_data").alias("j")).collect()}
    assert out == {1: {"a": 100.0, "token": deep.MASK, "b": [1.5]}, 2: {"a": 1.5, "z": "token"}, 3: {"x": {"token": deep.MASK}}}


def test_masking_depth_and_raw(spark, landed):
    document = {
        "secret": {"a": 1},
        "list": [{"token": 1}, [{"token": 2}], "token"],
        "Password": "kept",
        "price": 1.50,
        "text": '"token":',
        "big": 12345678901234567890.123456789,
    }
    raw = json.dumps(document).replace("1.2345678901234567e+19", "12345678901234567890.123456789")
    masked = ingest.mask_fields(
        ingest.parse_messages(landed([("a.b", 0, 1, raw)])), mask_raw=True
    ).select(F.to_json("event_data").alias("j"), "raw_payload").head()
    assert json.loads(masked.j)["list"] == [{"token": "***MASKED***"}, [{"token": 2}], "token"]
    assert json.loads(masked.j)["secret"] == "***MASKED***"
    assert json.loads(masked.j)["Password"] == "kept"
    assert "12345678901234567890.123456789" in masked.j
    assert "***MASKED***" in masked.raw_payload


def test_mask_helper_keeps_numbers_and_private_characters():
    doc = '{"a":1.10,"b":"0","token":2.50}'
    out = deep.reprinted(doc, hidden=frozenset({"token"}))
    assert json.loads(out) == {"a": 1.1, "b": "0", "token": "***MASKED***"}
    assert '"a":1.10' in out


def test_tables_are_allowed_under_any_of_their_names(landed):
    places = {1: ("fleet", "yard", "trucks"), 2: ("fleet", None, "trucks"), 3: ("depot", None, "trucks"), 4: ("fleet", "yard", "vans")}
    rows = [("t.x", 0, i, flat("u", after={"id": i}, db=d, schema=s, table=t)) for i, (d, s, t) in places.items()]
    parsed = ingest.parse_messages(landed([*rows, ("t.x", 0, 5, {"op": "u"})]))
    kept = lambda *names: sorted(r.offset for r in ingest.filter_tables(parsed, allowed=names).collect())
    assert kept("fleet.yard.trucks", "fleet.trucks") == [1, 2, 5]
    assert kept("depot.trucks") == [3, 5]
    assert kept("yard.vans") == [4, 5]


def test_inferred_columns(landed):
    document = flat("u", {"id": 1, "status": "a"}, {"id": 1, "status": "b", "active": True, "metadata": {"x": 1}, "__op": 1})
    columns = catalog.discover_columns(ingest.parse_messages(landed([("orderdb.t", 0, 1, document)])))
    found = {r.column_name: (r.data_type, r.is_nullable) for r in columns.collect()}
    assert found == {
        "id": ("integer", False), "status": ("string", False), "active": ("boolean", False), "metadata": ("object", False),
    }


def test_declared_columns_in_both_shapes(landed):
    fields = [
        {"field": "id", "type": "int32", "optional": False, "primaryKey": True},
        {"field": "status", "type": "string"},
        {"field": "price", "type": {"type": "bytes", "name": "Decimal"}},
        {"field": "__deleted", "type": "string"},
    ]
    listed = {"schema": {"fields": [{"field": "before", "fields": fields}, {"field": "after", "fields": []}]}}
    keyed = {"schema": {"fields": {"before": {"fields": []}, "after": {"fields": fields}}}}
    bare = {"payload": {"schema": {"fields": {"id": {"type": "int32"}, "op": "x"}}}}
    source = {"source": {"name": "s", "db": "d", "table": "t"}}
    rows = landed(
        [(f"s{i}.t", 0, i, {**d, **source, "after": {"z": 1}}) for i, d in enumerate((listed, keyed, bare))]
    )
    found = {}
    for r in catalog.event_columns(ingest.parse_messages(rows)).collect():
        found.setdefault(r.offset, {})[r.column_name] = (r.data_type, r.is_primary_key, r.is_nullable)
    expected = {"id": ("int32", True, False), "status": ("string", False, True), "price": ("Decimal", False, True)}
    assert found[0] == expected and found[1] == expected
    assert found[2] == {"id": ("int32", False, True)}


def test_qualified_table_uses_the_topic_prefix(landed):
    document = flat("c", after={"id": 1}, name="other", db="inv", schema="sales", table="orders")
    table = catalog.discover_tables(ingest.parse_messages(landed([("sqlserver.inventory.orders", 0, 1, document)]))).head()
    assert (table.service_name, table.database_name, table.table_name) == ("sqlserver", "inv", "sales.orders")


def graph(landed, rows):
    events = ingest.with_row_identity(ingest.prepare_events(landed(rows)))
    return events, changes.column_changes(events, catalog.discover_columns(events))


def test_inserts_give_one_change_per_column(landed):
    rows = [
        ("orderdb.shop.orders", 0, i, flat("c", after={"id": i, "status": "new", "total": 1.5})) for i in range(5)
    ]
    events, found = graph(landed, rows)
    assert events.count() == 5 and found.count() == 15
    first = found.where("offset = 0 and column_name = 'status'").head()
    assert (first.old_value, first.new_value, first.row_identity) == (None, '"new"', '{"id":0}')


def test_updates_deletes_and_null(landed):
    rows = [
        ("orderdb.shop.orders", 0, 1, flat("u", {"id": 1, "a": 1, "b": None}, {"id": 1, "a": 1.0, "c": None, "d": 2})),
        ("orderdb.shop.orders", 0, 2, flat("d", {"id": 1, "a": 1})),
        ("orderdb.shop.orders", 0, 3, flat("u", {"id": 1, "a": 1})),
        ("orderdb.shop.orders", 0, 4, {"payload": flat("u", {"id": 1, "a": 1}, {"id": 1, "a": 2})}),
    ]
    events, found = graph(landed, rows)
    got = {(r.offset, r.column_name): (r.old_value, r.new_value) for r in found.collect()}
    assert got == {
        (1, "d"): (None, "2"),
        (2, "id"): ("1", None), (2, "a"): ("1", None),
        (3, "id"): ("1", None), (3, "a"): ("1", None),
        (4, "a"): ("1", "2"),
    }
    # Looking at the top level only, an enveloped event shows no change.
    assert changes.column_deltas(events, unwrap_envelope=False).where("offset = 4").count() == 0


def test_redelivered_positions(landed):
    rows = landed([("t.x", 0, i, {"op": "c"}) for i in range(3)])
    events = ingest.parse_messages(rows)
    first = dedupe.new_positions(events.unionByName(events), events.limit(0))
    assert first.count() == 3
    assert dedupe.new_positions(events, events).count() == 0


def test_current_state_ignores_arrival_order(landed):
    rows = [
        ("orderdb.s", 0, 3, flat("d", {"id": 2}, ts_ms=3000)),
        ("orderdb.s", 0, 2, flat("u", {"id": 1, "v": 1}, {"id": 1, "v": 2}, ts_ms=2000)),
        ("orderdb.s", 0, 1, flat("c", after={"id": 1, "v": 1}, ts_ms=1000)),
        ("orderdb.s", 0, 0, flat("c", after={"id": 2, "v": 9}, ts_ms=1000)),
    ]
    events, _ = graph(landed, rows)
    assert [r.row for r in changes.current_state(events).collect()] == ['{"id":1,"v":2}']


def test_value_at_tells_null_from_unknown(landed):
    rows = [
        ("orderdb.s", 0, 1, flat("c", after={"id": 1, "v": 1}, ts_ms=1000)),
        ("orderdb.s", 0, 2, flat("d", {"id": 1, "v": 1}, ts_ms=5000)),
    ]
    events, found = graph(landed, rows)
    tables = catalog.discover_tables(events)

    def ask(second, column="v"):
        when = datetime.fromtimestamp(second, tz=timezone.utc)
        r = changes.value_at(found, tables, "orderdb", "public.orders", column, when).head()
        return r.value, r.found

    # Numbers this small are seconds.
    assert ask(999) == (None, False)
    assert ask(1000) == ("1", True)
    assert ask(5000) == (None, True)
    assert ask(5000, "nope") == (None, False)
