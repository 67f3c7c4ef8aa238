import json
from datetime import datetime, timezone

import pytest
from conftest import at
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changetide.functions import origin, values
from changetide.operators import ingest

UTC = timezone.utc


def parse(landed, *documents):
    rows = [("orders.public.t", 0, i, d) for i, d in enumerate(documents)]
    return ingest.parse_messages(landed(rows)).orderBy("offset").collect()


def test_fields_of_a_plain_document(landed):
    document = {"event_type": "docked", "event_time": "2021-03-04T05:06:07+02:00", "user_id": "ferry-9", "service_name": "harbour"}
    row = parse(landed, document)[0]
    assert [row.event_type, row.user_id, row.parsed_service] == ["docked", "ferry-9", "harbour"]
    assert row.event_time.replace(tzinfo=UTC) == datetime(2021, 3, 4, 3, 6, 7, tzinfo=UTC)


@pytest.mark.parametrize("key", ["name", "server"])
def test_fields_of_a_change(landed, key):
    row = parse(landed, {"op": "d", "ts_ms": 1234567890123, "source": {key: "tides"}})[0]
    assert [row.event_type, row.operation, row.parsed_service] == ["d", "DELETE", "tides"]
    assert row.event_time.replace(tzinfo=UTC) == datetime(2009, 2, 13, 23, 31, 30, 123000, tzinfo=UTC)


def test_a_name_goes_before_a_server(landed):
    assert parse(landed, {"source": {"server": "s", "name": "n"}})[0].parsed_service == "n"


def test_malformed_and_wrapped_documents(landed):
    bad, array, number, text = parse(landed, "INVALID { JSON ]", "[1,2]", "5", '"x"')
    assert (bad.event_type, bad.event_data, bad.raw_payload) == ("unparsed", None, "INVALID { JSON ]")
    assert [r.event_data.toPython() for r in (array, number, text)] == [
        {"data": [1, 2]}, {"data": 5}, {"data": "x"},
    ]
    assert {r.event_type for r in (array, number, text)} == {"unknown"}


def test_alternatives_skip_empty_values(landed):
    rows = parse(
        landed,
        {"event_type": "", "type": 0, "op": "d"},
        {"event_type": "0", "type": "t"},
        {"event_type": "false"},
        {"event_type": False, "payload": {"op": "u"}},
        {"event_type": [], "type": {}, "op": None},
        {"user_id": 0, "userId": "", "user": ""},
        {"service_name": "", "service": "", "source": {"name": "n"}},
        {"service_name": None, "source": {"name": " n "}},
    )
    assert [r.event_type for r in rows[:5]] == ["d", "0", "false", "u", "unknown"]
    assert rows[5].user_id == ""
    assert rows[6].parsed_service == "" and rows[7].parsed_service == "n"


def test_time_kinds(landed):
    rows = parse(
        landed,
        {"event_time": "1696932610", "ts_ms": 1696932610000},
        {"event_time": 1696932610},
        {"event_time": "2023-10-10T10:10:10+05:00"},
        {"event_time": "2023-10-10T10:10:10.123456"},
        {"payload": {"ts_ms": 0}, "event_time": "2023-10-10"},
        {"event_time": "never"},
    )
    times = [r.event_time.replace(tzinfo=UTC) for r in rows]
    ten = datetime(2023, 10, 10, 10, 10, 10, tzinfo=UTC)
    assert times[:2] == [ten, ten]
    assert times[2] == datetime(2023, 10, 10, 5, 10, 10, tzinfo=UTC)
    assert times[3] == ten.replace(microsecond=123456)
    assert times[4] == datetime(2023, 10, 10, tzinfo=UTC)
    assert times[5] == at(5)  # the record's own time


def test_impossible_time_and_bad_bytes_are_errors(landed):
    rows = parse(landed, {"ts_ms": 10**15}, b"\xff\xfe{}", {"ts_ms": 1})
    assert [r.error for r in rows] == ["event time out of range", "invalid UTF-8", None]
    assert "�" in rows[1].raw_payload


def test_duplicate_keys_take_the_last_value(landed):
    assert parse(landed, '{"type":"a","type":"b"}')[0].event_type == "b"


def test_source_coordinates(landed):
    full, nested, none = parse(
        landed,
        {"source": {"name": "s", "db": "inventory", "schema": "sales", "table": "orders"}},
        {"payload": {"source": {"name": "m", "db": "shop", "collection": "orders"}}},
        {"source": {"name": "s", "table": "  "}},
    )
    assert full.table_name == "sales.orders" and full.database_name == "inventory"
    assert (nested.table_name, nested.source_namespace) == ("orders", None)
    assert none.table_name is None and none.table_id is None


def test_filter_names(spark):
    names = spark.range(1).select(
        origin.filter_names(F.lit("inventory"), F.lit("sales"), F.lit("orders"))
    ).head()[0]
    assert names == ["orders", "sales.orders", "inventory.orders", "inventory.sales.orders"]


def test_canonical_json(spark):
    rows = spark.createDataFrame([(None,), ('"row-1"',), ('{ "id" : 1 }',)], "j string")
    found = rows.select(F.to_json(values.parse_json(F.col("j")))).collect()
    assert [r[0] for r in found] == [None, '"row-1"', '{"id":1}']


def test_same_value(spark):
    pairs = [("1", "1.0", True), ("1", "true", False), ('"1"', "1", False), (None, None, True),
             ("9007199254740993", "9007199254740992", False), ("0.5", "0.50", True)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    found = rows.select(values.same_value(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [p[2] for p in pairs]


def test_legacy_position(spark):
    schema = (
        "broker_kind string, broker_destination string, broker_substream string, broker_position string, "
        "kafka_topic string, kafka_partition int, kafka_offset long"
    )
    rows = spark.createDataFrame(
        [
            ("kafka", "d", "3", "9", None, None, None),
            ("kafka", "d", "x", "y", None, None, None),
            ("rabbitmq", "q", "", "45", None, None, None),
            ("kafka", "d", "1", "1", "t", 2, 7),
        ],
        schema,
    )
    found = [tuple(r[0]) for r in rows.select(origin.message_position()).collect()]
    assert found == [("d", 3, 9), ("d", None, None), ("q", 0, 45), ("t", 2, 7)]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=6), inner, max_size=3),
    max_leaves=8,
)
known = st.fixed_dictionaries(
    {},
    optional={
        "event_type": json_values, "type": json_values, "op": st.sampled_from(["c", "u", "d", "r", "x", "", None]),
        "user_id": json_values, "user": st.text(max_size=5), "payload": json_values,
        "ts_ms": st.integers(0, 4_000_000_000_000), "event_time": st.text(max_size=12),
    },
)


@settings(max_examples=5, phases=[Phase.generate], deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(json_values | known | st.text(max_size=12).map(lambda t: "{" + t), min_size=5, max_size=25))
def test_parser_never_fails_and_keeps_the_payload(landed, documents):
    texts = [json.dumps(d) if not (isinstance(d, str) and d.startswith("{")) else d for d in documents]
    rows = parse(landed, *texts)
    assert len(rows) == len(texts)
    for row, raw in zip(rows, texts, strict=True):
        assert row.raw_payload == raw and row.event_time is not None and row.operation
        try:
            value = json.loads(raw)
        except ValueError:
            assert row.event_type == "unparsed" and row.event_data is None
            continue
        if isinstance(value, dict):
            first = value.get("event_type") or value.get("type") or value.get("op")
            if isinstance(first, str) and first:
                assert row.event_type == first
        else:
            assert row.event_data.toPython().keys() == {"data"}


@pytest.mark.parametrize("bad", ["nodots", "os:", ":x", "no_such_module_here:f", "os:no_such"])
def test_bad_processor_references(bad):
    with pytest.raises(ValueError):
        ingest.load_processor(bad)


def test_masking_in_the_jvm_equals_the_walk(spark):
    import json
    import random

    from changetide.functions import deep

    rng = random.Random(5)
    scalars = [1, -2.5, 1e30, True, False, None, "", "x", "a,\"token\":1", "q\\", "{\"secret\":", "é\U0001f600", "[[", "\u0001", "token"]
    keys = ["token", "secret", "tokens", "a", "Token", "x token"]

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.5:
            return rng.choice(scalars)
        if kind < 0.8:
            return {rng.choice(keys): value(depth + 1) for _ in range(rng.randint(0, 4))}
        return [value(depth + 1) for _ in range(rng.randint(0, 3))]

    docs = [json.dumps({k: value(0) for k in keys}, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for _ in range(400)]
    rows = spark.createDataFrame([(d,) for d in docs], "d string")
    names = ("token", "secret")
    got = rows.select("d", deep.mask_json(F.col("d"), names, compact=True).alias("fast"), deep.mask_json(F.col("d"), names).alias("slow"))
    found = got.collect()
    assert len(found) == 400
    for r in found:
        assert json.loads(r.fast) == json.loads(r.slow), r.d
    plan = spark.createDataFrame([('{"token":"x","n":[1]}',)], "d string").select(deep._plainly(F.col("d"), names)[0].alias("e")).head()
    assert plan.e is False
