"""Filters, roll-ups, costs, calendars, devices: literal cases and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import display, models
from tokenloom.operators import calendar, devices, pricing, rollups
from tokenloom.operators.filters import SHARED, UsageFilter, last_days
from tokenloom.sources.tables import TOKENS

EVENT = "seq long, source string, ts long, model string, session string, project string, device_id string, observed_on array<string>, dedup_key string, dedup_rank int, " + ", ".join(f"{t} long" for t in TOKENS)
DAY = 86_400


def events(spark, *rows):
    """(source, ts, model, session, project, output, observers)"""
    data = [(i, s, ts, m, session, p, (seen or [None])[0], seen, None, 0, 10, out, 0, 0, 0) for i, (s, ts, m, session, p, out, seen) in enumerate(rows)]
    return spark.createDataFrame(data, EVENT).withColumn("total", F.expr(" + ".join(TOKENS)))


@pytest.fixture(scope="module")
def some(spark):
    return events(
        spark, ("claude", DAY, "m1", "s1", "p", 100, ["a"]), ("claude", DAY + 5, "m2", "s1", "p", 200, ["a", "b"]), ("codex", 3 * DAY, "m1-high", "s1", "q", 300, ["b"]),
        ("codex", 0, None, "", "q", 400, ["b"]), ("codex", 9 * DAY, "<synthetic>", "s2", None, 0, ["b"]))


@pytest.mark.parametrize("f, kept", [
    (UsageFilter(), [0, 1, 2, 3, 4]), (UsageFilter(sources=("codex",)), [2, 3, 4]), (UsageFilter(since="1970-01-02"), [0, 1, 2, 4]), (UsageFilter(until="1970-01-04"), [0, 1, 2, 3]),
    (UsageFilter(since="1970-01-02", until="1970-01-02"), [0, 1]), (UsageFilter(model="m1"), [0]), (UsageFilter(project="q", session=""), [3]), (UsageFilter(device="a"), [0, 1]), (UsageFilter(device=SHARED), [1]), (last_days("1970-01-04", 1), [2])])
def test_filters(some, f, kept):
    assert sorted(r.seq for r in f.apply(some).collect()) == kept


def test_last_days_bounds():
    for n in (0, 36_501):
        with pytest.raises(ValueError):
            last_days("2025-01-01", n)


def test_rollups_agree(some):
    rows = rollups.all_rollups(some).collect()
    by = {}
    for r in rows:
        by[r.dimension] = by.get(r.dimension, 0) + r.total
    assert by["total"] == by["source"] == by["device"] == 1050 and by["day"] == by["hour"] == 640
    assert {r.label for r in rows if r.dimension == "device"} == {"a", "b", SHARED}
    total = rollups.rollup(some).first()
    assert (total.requests, total.sessions, total.last_ts) == (5, 3, 9 * DAY)


def test_top_ties_go_to_the_smallest_name(spark):
    df = events(spark, ("claude", 1, "b", "s", "p", 5, ["a"]), ("claude", 1, "a", "s", "p", 5, ["a"]), ("claude", 1, "c", "s", "p", 1, ["a"]))
    assert rollups.tops(df, ["session"], ["model"]).first().top_model == "a"


def rates(spark, *rows):
    return spark.createDataFrame(list(rows), "model string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double")


def test_costs_and_coverage(spark, some):
    df = spark.createDataFrame([(0, "m", *[1_000_000] * 5)], "seq long, model string, " + ", ".join(f"{t} long" for t in TOKENS)).withColumn("total", F.expr(" + ".join(TOKENS)))
    row = pricing.priced(df, rates(spark, ("m", 5.0, 25.0, None, None, None))).select(pricing.dollars(F.col("cost")).alias("c")).first()
    assert row.c == pytest.approx(5 + 25 + 0.5 + 6.25 + 10)
    out = pricing.priced(some, rates(spark, ("m1", 1.0, 1.0, None, None, None))).agg(F.sum("priced_tokens").alias("p"), F.sum("unpriced_tokens").alias("u")).first()
    assert (out.p, out.u) == (420, 630)  # an effort level is no other price
    assert sorted(r.model for r in pricing.unpriced_models(some, rates(spark, ("m1", 1.0, 1.0, None, None, None))).collect()) == ["<synthetic>", "m2"]
    assert spark.range(1).select(pricing.coverage(F.lit(300), F.lit(100)).alias("a"), pricing.coverage(F.lit(0), F.lit(0)).alias("b")).first() == (0.75, 1.0)


def test_rates_are_checked_and_overridden(spark):
    bad = rates(spark, ("a", -1.0, 1.0, None, None, None), ("b", 1.0, float("inf"), None, None, None), ("", 1.0, 1.0, None, None, None), ("c", 1.0, 1.0, None, None, None), ("d", None, 1.0, None, None, None))
    assert {r.model: r.problem for r in pricing.valid(bad).collect()} == {"a": "bad rate", "b": "bad rate", "": "no model", "d": "bad rate"}
    out = pricing.overridden(rates(spark, ("a", 1.0, 2.0, 3.0, None, None)), rates(spark, ("a", 5.0, 6.0, None, None, None), ("new", 1.0, 1.0, None, None, None), ("zero", 0.0, 0.0, None, None, None)))
    assert {r.model: (r.input, r.cache_read) for r in out.collect()} == {"a": (5.0, None), "new": (1.0, None)}


def daily(spark, *days):
    return spark.createDataFrame([(dt.date(2025, 1, d), t) for d, t in days], "date date, total long")


@pytest.mark.parametrize("days, streak", [([(1, 5), (2, 5), (3, 5)], 3), ([(1, 5), (2, 5)], 2), ([(1, 5)], 0), ([(1, 5), (3, 5)], 1), ([(2, 0), (3, 1)], 1), ([], 0), ([(3, 1), (4, 9)], 1)])
def test_streak(spark, days, streak):
    assert calendar.streak(daily(spark, *days), "2025-01-03").first().streak == streak


def test_dense_days(spark):
    out = calendar.dense(spark, daily(spark, (1, 5), (4, 7), (9, 1)), "2025-01-05", 5, {"total": 0}).orderBy("date").collect()
    assert [r.total for r in out] == [5, 0, 0, 7, 0]


def test_merge_of_devices(spark):
    rows = [(0, "claude", 5, "m", "s", "p", "d2", None, "k", 0, 1, 1, 0, 0, 0), (1, "claude", 5, "m", "s", "p", "d1", None, "claude:v1:k", 1, 1, 1, 0, 0, 0), (2, "codex", 5, "m", "s", "p", "d1", None, "k", 0, 1, 1, 0, 0, 0)]
    rows += [(3 + i, "claude", 5, "m", "s", "p", d, None, None, 0, 1, 1, 0, 0, 0) for i, d in enumerate(("d1", "d1", "d2"))]
    df = spark.createDataFrame(rows, EVENT).drop("observed_on")
    out = {r.seq: r.observed_on for r in devices.merged(devices.with_canonical_id(df)).collect()}
    assert out == {1: ["d1", "d2"], 2: ["d1"], 3: ["d1", "d2"], 4: ["d1"]}
    assert devices.merged(devices.with_canonical_id(df.where("false"))).count() == 0


def test_bundles_are_refused_whole(spark):
    bundles = [(0, 1, "d-1", "0.4"), (1, 2, "d-1", "0.4"), (2, 1, "d_1", "0.4"), (3, 1, "me", "0.4"), (4, 1, "d-1", None), (5, 1, "d-2", "0.4"), (6, 1, "d-1", "0.4"), (7, 1, "d-1", "0.4"), (8, 1, "d-1", "0.4"), (9, None, None, None), (10, 1, "d-1", "0.4")]
    rows = [(0, "i", "m", "s", "p"), (6, "i", "m", "s", "a\u202eb"), (7, "i", "m", "s", "p"), (7, "j", "m", "s", "p"), (8, "i" * 90, "m", "s", "p")]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = devices.bundle_problems(
        of(bundles, "bundle_id long, bundle_version int, device_id string, exporter_version string"), of(rows, "bundle_id long, id string, model string, session string, project string"),
        of([("d-1", "anvil"), ("me", "here"), ("d-2", "x" * 129)], "device_id string, name string"), "me", most_events=1, most_bytes=90)
    assert {r.bundle_id: r.problem for r in found.collect()} == {1: "version", 2: "device id", 3: "local device", 4: "exporter version", 5: "device name", 6: "unsafe text", 7: "too many events", 8: "too much text", 9: "version"}


def shown(spark, f, *values, kind="long"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_display(spark):
    assert shown(spark, display.tokens, 842, 1300, 31_400_000, 3_000_000_000, 4_500, 9_999) == ["842", "1.3k", "31M", "3.0B", "4.5k", "10.0k"]
    assert shown(spark, display.money, 3481.7, 61.238, 0.5126, 0.0, kind="double") == ["$3,482", "$61.24", "$0.513", "$0"]
    assert shown(spark, display.share, 0.87, 0.999, 0.001, 0.0, 1.0, kind="double") == ["87%", ">99%", "<1%", "0%", "100%"]
    assert shown(spark, display.duration, 640, 2035, 23_456) == ["640ms", "2.04s", "23.5s"]
    assert shown(spark, lambda c: display.ellipsize(c, 4), "hello", "hell", None, kind="string") == ["hel…", "hell", None]
    assert shown(spark, display.preview, " a　\n b ", "x" * 4096 + " y", "x" * 4097, kind="string") == ["a b", "x" * 4096 + " …", "x" * 4096 + "…"]


def test_model_ids(spark):
    assert shown(spark, models.pricing_key, "m-20250101", "m-high", "m-xhigh", "m-mini", "m-high-20250101", "-high", kind="string") == ["m", "m", "m", "m-mini", "m-high", "-high"]
    assert shown(spark, models.normalize_model_b, "A/B/Model-X-2025-01-02", "m-20250101", "-20250101", kind="string") == ["model-x", "m", "-20250101"]
    assert shown(spark, models.project_label, " /a/b// ", "/", "C:\\", "C:\\x\\", kind="string") == ["/a/b", "/", "C:\\", "C:\\x"]
