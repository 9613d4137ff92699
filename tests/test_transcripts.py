"""Transcripts: lines, parsers, carried state, timelines, the plan of files, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.json_fields import split_cache_write
from tokenloom.operators import manifest, parse_a, parse_b, replay, rollups, snapshots
from tokenloom.sources import transcripts
from tokenloom.sources.files import lines_of
from tokenloom.sources.tail import Tail
from tokenloom.streaming import usage as streaming


def lines(spark, *values, path="/x/projects/-a-b/s.jsonl"):
    return spark.createDataFrame([(path, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "path string, line int, value string")


def message(out=20, stop=None, **more):
    usage = {"input_tokens": 10, "output_tokens": out, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 40, "cache_creation": {"ephemeral_5m_input_tokens": 15, "ephemeral_1h_input_tokens": 25}}
    return {"type": "assistant", "timestamp": "2025-01-01T00:00:00Z", "sessionId": "s", "message": {"id": "m1", "model": " opus ", "stop_reason": stop, "usage": usage}} | more


def test_parser_a(spark):
    rows = parse_a.usage(lines(
        spark, message(), {"type": "user", "cwd": "/w/"}, message(9, "end_turn"), message(cwd="/v", session_id="x"), '{"type": "assistant", "usage": ',
        {**message(), "message": {**message()["message"], "model": "<synthetic>"}}, {**message(), "message": {**message()["message"], "usage": {"input_tokens": "7", "output_tokens": -1}}})).orderBy("line").collect()
    assert [(r.line, r.project, r.dedup_rank, r.output_tokens) for r in rows] == [(0, "a-b", 0, 20), (2, "/w", 1, 9), (3, "/v", 0, 20)]
    assert (rows[0].model, rows[0].ts, rows[0].cache_write_5m, rows[0].cache_write_1h) == ("claude-opus-5", 1735689600, 15, 25)


@pytest.mark.parametrize("total, five, hour, split, out", [(4207, 0, 1900, True, (0, 4207)), (100, 1, 1, True, (50, 50)), (500, 0, 0, False, (500, 0)), (0, 3, 4, True, (0, 0)), (40, 15, 25, True, (15, 25)), (2**62, 2**62, 2**62, True, (2**61, 2**61))])
def test_split(spark, total, five, hour, split, out):
    df = spark.createDataFrame([(total, five, hour, split)], "t long, f long, h long, s boolean")
    assert tuple(int(x) for x in df.select(*split_cache_write(F.col("t"), F.col("f"), F.col("h"), F.col("s"))).first()) == out


def count(total=None, last=None, lane=None):
    triple = lambda t: t and dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), t))
    return {"type": "event_msg", "timestamp": "2025-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": triple(total), "last_token_usage": triple(last)}, "rate_limits": {"limit_id": lane}}}


@pytest.mark.parametrize("given, out", [
    ([count((52310, 20480, 911), (23001, 20480, 517))], [(2521, 20480, 517)]),
    ([count((840, 0, 60), (840, 0, 60)), count((27000, 0, 290), (410, 0, 230))], [(840, 0, 60), (410, 0, 230)]),
    ([count((10, 0, 1), (10, 0, 1))] * 2, [(10, 0, 1)]),
    ([count((10, 0, 1), None, "a"), count((20, 0, 2), None, "b"), count((10, 0, 1), None, "a")], [(10, 0, 1), (10, 0, 1)]),
    ([count((1200, 300, 90)), count((2900, 900, 210))], [(900, 300, 90), (1100, 600, 120)]),
    ([count((6100, 0, 430)), count((2700, 0, 180))], [(6100, 0, 430)]),
    ([count(None, (12, 90, 7))] * 2, [(0, 12, 7)] * 2),
    ([{"type": "event_msg", "payload": {"type": "token_count", "info": None}}], [])])
def test_parser_b(spark, given, out):
    rows = parse_b.usage(lines(spark, *given, path="/y/t1.jsonl")).orderBy("line").collect()
    assert [(r.input_tokens, r.cache_read, r.output_tokens) for r in rows] == out
    assert {r.session for r in rows} <= {"t1"} and len({r.dedup_key for r in rows}) == len(rows)


def test_parser_b_carries_state(spark):
    head = [{"type": "session_meta", "payload": {"id": "th", "cwd": "/m"}}, {"type": "turn_context", "payload": {"model": "V/Mod-20250101", "cwd": "/t/"}}, {"type": "session_meta", "payload": {"id": "no", "cwd": "/n"}}]
    row = parse_b.usage(lines(spark, *head, count((10, 0, 1)), path="/y/t1.jsonl")).first()
    assert (row.session, row.model, row.project) == ("th", "mod", "/t")


def test_torn_tail(spark, tmp_path):
    """The line feed counts, not whether the last line is JSON."""
    for name, data in (("whole", b'{"a": 1}\n{"b": \n'), ("torn", b'{"a": 1}\n{"b": 2}'), ("marked", b'\xef\xbb\xbf{"a": 1}\n{"b": 2}'), ("empty", b""), ("blank", b"\n\n"), ("crlf", b"x\r\ny\r")):
        (tmp_path / f"{name}.jsonl").write_bytes(data)
    got = transcripts.complete(transcripts.read_lines(spark, [str(tmp_path)], "claude", recursive=True)).collect()
    kept = sorted((r.path.rsplit("/", 1)[1].split(".")[0], r.line, r.value) for r in got)
    assert kept == [("blank", 1, ""), ("blank", 2, ""), ("crlf", 1, "x\r"), ("marked", 1, '{"a": 1}'), ("torn", 1, '{"a": 1}'), ("whole", 1, '{"a": 1}'), ("whole", 2, '{"b": ')]


def test_counts_stop_at_the_largest_number(spark):
    """A hostile count never stops a scan."""
    def line(**usage):
        return json.dumps({"type": "assistant", "message": {"id": "m", "model": "a", "usage": usage}})

    df = lines(spark, line(input_tokens=18446744073709551615, output_tokens=5, cache_creation_input_tokens=18446744073709551615), line(input_tokens=18446744073709551616, output_tokens=-3, cache_read_input_tokens="9", cache_creation_input_tokens=1.5), line(output_tokens=7))
    rows = {r.line: (r.input_tokens, r.output_tokens, r.cache_read, r.cache_write_5m) for r in parse_a.usage(df).collect()}
    most = (1 << 63) - 1
    assert rows == {0: (most, 5, 0, most), 2: (0, 7, 0, 0)}
    events = parse_a.usage(df).selectExpr("*", "input_tokens as total")
    assert rollups.rollup(events).first().input_tokens == most
    snap = json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 18446744073709551615, "output_tokens": 18446744073709551615}}}})
    got = parse_b.usage(lines(spark, snap)).first()
    assert (got.input_tokens, got.output_tokens) == (most, most)


def test_deeply_nested_values(spark):
    deep = '{"v":' + "[" * 900 + "1" + "]" * 900 + "}"
    rows = spark.createDataFrame([(deep,), ('{"v":' * 90 + '{"status":"failed"}' + "}" * 90,), ("[" * 100_000,), (None,)], "v string")
    out = [tuple(r) for r in rows.select(replay.value_preview("v"), replay.reports_failure("v")).collect()]
    assert [failed for _, failed in out] == [False, True, False, False] and out[3][0] is None and len(out[2][0]) == 4097


def test_blocks_of_every_form(spark):
    """Text, blocks, missing, null and other content; records without a message; a uuid too long, and none."""
    def record(type="user", uuid="u", **rest):
        return json.dumps({"type": type, "uuid": uuid, **rest})

    rows = [
        record(message={"role": "system", "content": " a \n b "}), record(message={"role": "user", "content": ""}), record("assistant", message={"content": [{"type": "text", "text": "hi"}, {"type": "text", "text": " "}, {"type": "odd"}]}),
        record(message={"role": "user"}), record(message={"content": {"text": "x"}}), record(message=None), record("system", content="note"), record("system", content=""), record("system"), record("system", content=[{"text": "x"}]),
        record("summary", message={"content": "x"}), record(uuid="v" * 600, message={"content": "long"}), record(uuid=None, message={"content": [{"type": "tool_use", "id": "c", "name": "sh", "input": {"stdout": "ok"}}]}),
        record(message={"content": [{"type": "tool_result", "tool_use_id": "c", "is_error": True, "content": [{"text": "bad"}]}, {"type": "tool_result", "tool_use_id": "z", "is_error": "yes"}]}),
    ]
    df = spark.createDataFrame([("claude", "s", i, r) for i, r in enumerate(rows)], "source string, session string, seq long, value string").selectExpr("source", "session", "seq", "parse_json(value) as record")
    got = sorted((r.seq, r.position, r.kind, r.title, r.detail, r.dedup_key) for r in replay.titled(replay.blocks(df), "seq", "position").collect())
    assert got == [
        (0, 0, "Assistant", "system", "a b", "u"), (1, 0, "User", "user", "", "u"), (2, 0, "Assistant", "assistant", "hi", "claude:u:0"), (6, 0, "System", "system", "note", "u"), (9, 0, "System", "system", "x", "u"),
        (11, 0, "User", "user", "long", "v" * 512), (12, 0, "ToolCall", "sh", "ok", None), (13, 0, "ToolError", "sh", "bad", "claude:u:0"), (13, 1, "ToolResult", "tool result", "", "claude:u:1"),
    ]


def test_reading_files(spark, tmp_path):
    for name in ("p/a.jsonl", "p/s/subagents/b.jsonl", "p/archived_sessions/c.jsonl", "p/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1\n2\n3\n")
    rows = transcripts.read_lines(spark, [str(tmp_path)], "codex", recursive=True).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in rows) == [(f, i, str(i)) for f in ("a.jsonl", "b.jsonl") for i in (1, 2, 3)]
    own = transcripts.read_lines(spark, [f"{tmp_path}/{g}" for g in transcripts.DEPTHS if "workflows" not in g], "claude").select("path").distinct().collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in own) == ["a.jsonl", "b.jsonl"]


@pytest.mark.parametrize("old, new, action", [
    (None, (1, 10, 5), "Full"), ((1, 10, 5), (1, 10, 5), "Unchanged"), ((1, 10, 5), (1, 10, 6), "Full"), ((1, 10, 5), (1, 15, 6), "Append"), ((1, 10, 5), (1, 9, 6), "Full"), ((1, 10, 5), (2, 15, 6), "Full"), ((1, 10, 5), None, "Forgotten")])
def test_plan_of_files(spark, old, new, action):
    a = spark.createDataFrame([("f", *old)] if old else [], "path string, identity long, offset long, modified long")
    b = spark.createDataFrame([("f", *new)] if new else [], "path string, identity long, size long, modified long")
    row = manifest.plan(a, b).first()
    assert (row.action, row.begin) == (action, 10 if action == "Append" else 0)


def test_windows(spark):
    df = spark.createDataFrame([("f", 0, None), ("f", 1, "a"), ("f", 2, None), ("f", 3, "b"), ("g", 4, None)], "file string, line int, x string")
    assert [r.x for r in snapshots.carried(df, "x").orderBy("line").collect()] == [None, "a", "a", "b", None]
    assert [r.x for r in snapshots.first_seen(df, "x").orderBy("line").collect()] == [None, "a", "a", "a", None]


ROW = "source string, session string, seq long, ts_ms long, kind string, title string, detail string, call_id string, dedup_key string"


def test_timeline(spark):
    df = spark.createDataFrame([("a", "s", 0, 3000, "ToolCall", "shell", "x", "c", None), ("a", "s", 1, 2000, "User", "u", "y", None, "k"), ("a", "s", 2, 0, "ToolResult", None, "z", "c", None), ("a", "s", 3, 2000, "User", "u", "y", None, "k"), ("a", "s", 4, 0, "ToolError", None, "w", "d", None)], ROW)
    once = replay.once(df)
    out = {r.seq: r.offset_ms for r in replay.offsets(once).collect()}
    assert out == {0: 1000, 1: 0, 2: 2000, 4: 3000}
    assert {r.seq: r.call_name for r in replay.call_names(once).where("call_name is not null").collect()} == {2: "shell", 4: "tool result"}
    assert [r.seq for r in replay.ordered(once).orderBy("place").collect()] == [1, 0, 2, 4]
    assert replay.summary(replay.offsets(once)).first()[2:] == (2000, 3000, 3000, 4)


def test_limits(spark):
    df = spark.createDataFrame([("a", "s", i, 0, "User", "tt", d, None, None) for i, d in enumerate(("x" * 10, "y" * 60, "z", "w"))], ROW)
    assert [(r.seq, r.detail) for r in replay.truncated(df, 60).orderBy("seq").collect()] == [(0, "x" * 10), (1, replay.OMITTED), (2, "z")]
    assert replay.truncated(df, 1000, 2).count() == 2


def test_nested_values(spark):
    df = spark.createDataFrame([('[{"text": " a  b"}, {"image_url": 1}, null, 7]',), ('{"x": {"status": "failed"}}',), ("no json",), (None,)], "j string")
    assert [r.v for r in df.select(replay.value_preview("j").alias("v")).collect()] == ["a b [image] 7", '{"x":{"status":"failed"}}', "no json", None]
    assert [r.v for r in df.select(replay.reports_failure("j").alias("v")).collect()] == [False, True, False, False]


def test_byte_ranges_make_whole_lines(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\n\nfour\ntor")
    whole = list(lines_of(str(f), 0, 17))
    for cut in range(18):
        assert [(o, v) for b, e in ((0, cut), (cut, 17)) for o, v in lines_of(str(f), b, e)] == whole == [(0, "one"), (4, "two"), (8, ""), (9, "four")]


def test_tail_source(spark, tmp_path):
    spark.dataSource.register(Tail)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("1\n2\nto")

    def run():
        query = spark.readStream.format("tail").option("path", str(folder)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2"]
    with (folder / "a.jsonl").open("a") as f:
        f.write("rn\n3\n")
    assert run() == ["1", "2", "3", "torn"]


def test_replacing_stream(spark, tmp_path):
    schema = "seq long, key string, rank int, output long"
    batches = [[(0, "a", 0, 9), (1, "b", 1, 1), (2, None, 0, 0)], [(3, "a", 1, 1), (4, "b", 0, 99), (5, None, 0, 0)], [(6, "c", 0, 0), (7, "a", 1, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streaming.replaced(stream, F.col("key"), [F.col("rank"), F.col("output")], F.col("seq"))
    assert sorted(r.seq for r in out.collect()) == [1, 2, 3, 5, 6]


def test_late_rows_land_in_their_day(spark, tmp_path):
    schema = "ts long, total long"
    for i, rows in enumerate([[(86_400 * 50, 1)], [(86_400 * 2, 5), (0, 7)], [(86_400 * 50 + 9, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert sorted((r.date, r.total) for r in streaming.finished(streaming.by_day(stream), "complete").collect()) == [("1970-01-03", 5), ("1970-02-20", 3)]
