"""Conversations from message rows, against brute force."""

import random

import pytest

from tokenloom.llm import conversations

EVENTS = "event_id long, source string, session string, project string, order_no long, ts_ms long, kind string, title string, detail string, call_id string, dedup_key string"
REQUESTS = "request_id long, source string, session string"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "toolcall": "ToolCall", "toolresult": "ToolResult", "toolerror": "ToolError"}


def brute(events, requests):
    seen, sessions = set(), {(s or "").strip().lower(): [] for _, _, s in requests}
    for e in sorted(events):
        sid = (e[2] or "").strip().lower()
        rows = sessions.setdefault(sid, [])
        if e[10] is not None and (sid, e[10]) in seen:
            continue
        seen.add((sid, e[10]))
        rows.append(e)
    out = {}
    for sid, rows in sessions.items():
        kind = lambda e: "".join(c for c in (e[6] or "").lower() if c.isalpha())
        rows.sort(key=lambda e: ((e[5] or 0) <= 0, max(e[5] or 0, 0), e[4], e[0]))
        said = [kind(e) for e in rows if kind(e) in ("user", "assistant") and (e[8] or "").strip()]
        calls, orphan = set(), False
        for e in rows:
            if kind(e) == "toolcall":
                calls.add(e[9])
            elif kind(e) in ("toolresult", "toolerror"):
                orphan |= e[9] is None or e[9] not in calls
        numbers = {e[4] for e in rows}
        if not said:
            out[sid] = "empty"
        elif numbers != set(range(max(numbers) + 1)) or said[0] == "assistant" or orphan:
            out[sid] = "broken"
        elif any(a == "user" and b == "user" for a, b in zip(said, [*said[1:], "user"])):
            out[sid] = "missing_reply"
    return out


def event(i, session, order, ts, kind, detail="x", call=None, key=None):
    return (i, "claude", session, None, order, ts, kind, None, detail, call, key)


def defects(spark, events, requests=()):
    out = conversations.defects(spark.createDataFrame(list(events), EVENTS), spark.createDataFrame(list(requests), REQUESTS))
    return {r.session: r.defect for r in out.collect()}


@pytest.mark.parametrize("seed, crowded", [(1, 50_000), (2, 2)])
def test_random_sessions(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(conversations, "CROWDED", crowded)
    rnd = random.Random(seed)
    events, i = [], 0
    for s in range(40):
        order, kinds = 0, []
        for _ in range(rnd.randint(1, 6)):
            kinds += rnd.choice([["User", "Assistant"], ["User", "ToolCall", "ToolResult", "Assistant"], ["User"], ["USER", " assistant"], ["System"], ["User", "TOOL-ERROR", "Assistant"]])
        for k in kinds:
            # Days lie between some rows, so that a session fills several shards.
            ts = 0 if rnd.random() < 0.1 else 1_700_000_000_000 + order * rnd.choice([1000, 40_000_000])
            call = f"c{order // 3}" if "TOOL" in k.upper() else None
            row = event(i, rnd.choice([f"S{s}", f" s{s}\n"]), order, ts, k, rnd.choice(["hi", "hi", "hi", " ", None]), call, rnd.choice([None, f"k{order}"]))
            events.append(row)
            i += 1
            if rnd.random() < 0.2:
                events.append((i, *row[1:]))
                i += 1
            order += rnd.choice([1, 1, 1, 1, 1, 2]) if rnd.random() < 0.3 else 1
    requests = [(0, "claude", "nobody"), (1, "claude", "S1"), (2, "claude", "nobody ")]
    assert defects(spark, events, requests) == brute(events, requests)


def test_defined_cases(spark):
    assert defects(spark, []) == {} and defects(spark, [], [(0, "claude", None)]) == {"": "empty"}
    events = [event(0, None, 0, 1, "User"), event(1, None, 1, 2, "Assistant"), event(2, "a", 0, None, "User", " "), event(3, "b", 0, 5, None), event(4, "c", 0, 9, "User"), event(5, "c", 1, 9, "Assistant"), event(6, "d", 0, 5, "User"), event(7, "d", None, 5, "Assistant")]
    assert defects(spark, events) == {"a": "empty", "b": "empty", "d": "broken"}  # a null number comes first


def test_whole_conversations(spark):
    gap = 10 * 3_600_000
    rows = [event(i, "a", i, 1_700_000_000_000 + i * 1000 + (gap if i > 3 else 0), "User" if i % 2 == 0 else "Assistant", f"t{i}") for i in range(6)]
    rows += [event(9, "b", 0, 1, "User")]  # lacks a reply
    df = spark.createDataFrame(rows, EVENTS)
    out = conversations.conversations(df, spark.createDataFrame([], REQUESTS), 3_600_000).orderBy("turn_no").collect()
    assert [(r.session, r.turn_no, r.part_no, r.role, r.detail) for r in out] == [("a", i, int(i > 3), ("user", "assistant")[i % 2], f"t{i}") for i in range(6)]


def test_a_crowded_shard_is_divided_by_time(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CROWDED", 10)
    rows = [event(i, "a", i, 1_700_000_000_000 + i * 1000, "User" if i % 2 == 0 else "Assistant") for i in range(200)]
    df = spark.createDataFrame(rows, EVENTS)
    sizes = [r["count"] for r in conversations.with_shard(conversations.timeline(df)).groupBy("shard").count().collect()]
    assert sum(sizes) == 200 and len(sizes) > 1
    out = conversations.conversations(df, spark.createDataFrame([], REQUESTS), 3_600_000).orderBy("turn_no").collect()
    assert [(r.turn_no, r.part_no, r.event_id) for r in out] == [(i, 0, i) for i in range(200)]


def test_gap_is_calibrated(spark):
    rows, ts = [], 1_700_000_000_000
    for i in range(300):
        ts += 30_000 if i % 20 else 5 * 3_600_000
        rows.append(event(i, "a", i, ts, "User"))
    gap = conversations.calibrated_gap(conversations.with_shard(conversations.timeline(spark.createDataFrame(rows, EVENTS))))
    assert 30_000 < gap < 5 * 3_600_000


def worked_days(days=16):
    """Days of messages ten minutes apart, some with a pause of 20 or 40 minutes, 14 hours or so between the days."""
    rows, ts = [], 1_700_000_000_000
    for day in range(days):
        for n in range(20):
            ts += 60_000 * (14 * 60 if n == 0 else 20 if n == 9 and day < 10 else 40 if n == 9 and day < 13 else 10)
            rows.append(event(len(rows), "a", len(rows), ts, "User" if n % 2 == 0 else "Assistant"))
    return rows


def test_gaps_between_shards_are_counted(spark):
    df = spark.createDataFrame(worked_days(), EVENTS)
    assert conversations.calibrated_gap(conversations.with_shard(conversations.timeline(df))) == 1 << 22  # the pauses of a day don't part it
    out = conversations.conversations(df, spark.createDataFrame([], REQUESTS)).collect()
    assert {r.event_id: r.part_no for r in out} == {i: i // 20 for i in range(320)}


@pytest.mark.parametrize("crowded", [50_000, 7, 1])
def test_every_gap_is_counted_once(spark, crowded):
    rnd, rows = random.Random(3), worked_days(3)
    for s in ("a", "b", None):
        ts = 1_700_000_000_000
        for order in range(60):
            ts += rnd.choice([0, 1, 3, 1000, 70_000, 4_000_000, 21_600_000, 90_000_000, 3_000_000_000])
            rows.append(event(len(rows), s, order, rnd.choice([ts, ts, ts, 0, None]), "User"))
    want = {}
    for s in ("a", "b", None):
        at = sorted(e[5] for e in rows if e[2] == s and e[5])
        for gap in (b - a for a, b in zip(at, at[1:]) if b > a):
            want[gap.bit_length() - 1] = want.get(gap.bit_length() - 1, 0) + 1
    placed = conversations.with_shard(conversations.timeline(spark.createDataFrame(rows, EVENTS)), crowded)
    assert conversations.gap_bins(placed) == want
