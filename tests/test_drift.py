"""Schemas that drift between files."""

import pytest

from tokenloom.operators import drift

SCHEMA = "feed string, file_no long, file_name string, line_no int, raw_line string"


def lines(spark, *files, feed="f"):
    return spark.createDataFrame([(feed, n, f"{n}.jsonl", i, line) for n, own in files for i, line in enumerate(own)], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in drift.file_changes(df).collect())


def test_changes_of_each_kind(spark):
    df = lines(
        spark, (0, ['{"a": 1, "t": {"write_5m": 1, "write_1h": 2}, "version": 1, "device": {"id": "x"}}']),
        (2, ['{"a": 1.0, "t": {"cacheWrite5m": 3, "write_1h": 2}, "format": {"version": 1}, "device": {"id": "x"}, "plan": true}']),
        (5, ['{"plan": true, "a": "1", "deviceId": "x", "t": {"write_1h": 2, "cacheWrite5m": 1}, "format": {"version": 2}}']),
    )
    assert found(df) == [
        (2, "added", "", "plan"), (2, "renamed", "t.write_5m", "t.cacheWrite5m"), (2, "renamed", "version", "format.version"), (2, "retyped", "a", "a"),
        (5, "renamed", "device.id", "deviceId"), (5, "retyped", "a", "a"),
    ]


def test_lines_that_are_no_records(spark):
    df = lines(spark, (0, ['{"a": 1}', '{"a": 1', "", "null", "[1]", "7", '{"a": null, "b": null}']), (1, ["   ", '{"b": 2, "a": 3, "l": []}']))
    assert found(df) == [(1, "added", "", "l")]


def test_null_only_fields_have_no_type(spark):
    df = lines(spark, (0, ['{"a": null}']), (1, ['{"a": 1}']), (2, ['{"a": null}']), (3, ['{"a": "x"}']))
    assert found(df) == []


def test_file_without_records_and_feeds_apart(spark):
    df = lines(spark, (0, ['{"a": 1}']), (1, ["{"]), (3, ['{"a": 1}'])).unionByName(lines(spark, (2, ['{"z": 1}']), feed="g"))
    assert found(df) == [(1, "removed", "a", ""), (3, "added", "", "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == [] and drift.union_schema(df) == {}


PATHS = {"tokens.cache_write_5m", "tokens.cache_write_1h", "tokens.input", "counters.cached_input", "counters.output", "exporter_version", "event.ts", "event.id", "event.session", "device.id", "device.name"}
SAMPLES = {"n": [0, 5, 7000], "v": [1, 1], "time": [1_736_947_977, 1_736_950_351], "dotted": ["0.4.2"], "box": ["Work machine"], "id": ["fallback:v1:96ad:0"], "hex": ["299e-ede"], "none": []}


@pytest.mark.parametrize("a, kind_a, b, kind_b, same", [
    ("tokens.cache_write_5m", "n", "tokens.cache_creation.ephemeral_5m", "n", True), ("tokens.cache_write_5m", "n", "tokens.cache_write_1h", "n", False), ("counters.cached_input", "n", "counters.cache_read_input", "n", True),
    ("exporter_version", "dotted", "format.version", "v", False), ("bundle_version", "v", "schemaVersion", "v", True), ("event.ts", "time", "event.timestamp", "time", True), ("event.session", "hex", "event.event_id", "id", False),
    ("device.name", "box", "device.label", "box", True), ("device.name", "box", "device.label", "hex", False), ("device.id", "id", "deviceId", "none", True), ("device.name", "none", "device.label", "none", False),
    # Other domains: customers, prices, places.
    ("customer.phone", "hex", "customerPhone", "hex", True), ("price", "n", "unit_price", "n", True), ("price", "n", "currency", "box", False), ("qty", "n", "quantity", "n", True), ("address.zip", "v", "address.city", "box", False), ("ship_date", "time", "shipping_dt", "time", True), ("ship_date", "time", "order_total", "n", False)])
def test_fields_that_are_the_same(a, kind_a, b, kind_b, same):
    def seen(kind):
        out = drift.Seen()
        for v in SAMPLES[kind]:
            out = out.and_value(v)
        return out

    worth = drift.weights(PATHS | {a, b})
    assert (drift.likeness(a, b, seen(kind_a), seen(kind_b), worth)[0] > 0) == same == (drift.likeness(b, a, seen(kind_b), seen(kind_a), worth)[0] > 0)


def test_profile_adds_up_over_batches(spark):
    values = [1, "2", None, 3.5, "x-1", "y-22", True]
    df = lines(spark, (0, [f'{{"a": {v}}}' for v in ("1", '"2"', "null", "3.5", '"x-1"', '"y-22"', "true")] + ["[" * 5000, "{", ""])).repartition(4)
    row = drift.profiles(df).first().fields[0]
    whole = drift.Seen()
    for v in values:
        whole = whole.and_value(v)
    assert row.path == "a" and [row[k] for k in drift.PROFILE][:5] == list(whole)[:5] and abs(row["size"] - whole.size) < 1e-9


def test_nulls_in_feed_and_file(spark):
    df = spark.createDataFrame([(None, 0, "f", 1, '{"a": 1}'), (None, 1, "f", 1, '{"b": 1}'), ("f", None, "f", 1, '{"z": 1}'), (None, 1, None, None, None)], SCHEMA)
    assert found(df) == [(1, "added", "", "b"), (1, "removed", "a", "")]


@pytest.mark.parametrize("schema, leaves", [
    ("OBJECT<>", []), ("OBJECT<a: BIGINT, b: OBJECT<c: VOID, d: DECIMAL(2,1)>, e: ARRAY<OBJECT<x: BIGINT>>>", [("a", 2), ("b.c", 0), ("b.d", 4), ("e", 8)]),
    ("OBJECT<`a b`: STRING, `c``<: d`: BOOLEAN>", [("a b", 8), ("c`<: d", 1)]), ("OBJECT<n: DECIMAL(20,0), f: DOUBLE>", [("n", 2), ("f", 4)])])
def test_leaves_of_a_schema(schema, leaves):
    assert drift.leaves_of(schema) == leaves


def test_lattice():
    assert [drift.kind_of(b) for b in (0, 1, 2, 4, 6, 8, 3, 10)] == ["", "boolean", "whole", "decimal", "decimal", "text", "text", "text"]


def test_one_table(spark):
    df = lines(spark, (0, ['{"device": {"id": "x"}, "n": 1}', '{"device": {"id": "x"}, "n": 1}']), (1, ['{"deviceId": "y", "n": 2.5, "device_ID": null}']))
    schema = drift.union_schema(df)
    rows = sorted(tuple(r) for r in drift.consistent(df, schema).collect())
    assert {k: v[0] for k, v in schema.items()} == {"device.id": "text", "n": "decimal"}
    assert rows == [("f", 0, 0, "x", 1.0), ("f", 0, 1, "x", 1.0), ("f", 1, 0, "y", 2.5)]


def test_very_long_line(spark):
    df = lines(spark, (0, ['{"a": "' + "x" * 1_000_000 + '"}']), (1, ['{"a": 1}']))
    assert found(df) == [(1, "retyped", "a", "a")]
