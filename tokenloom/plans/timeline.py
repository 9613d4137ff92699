"""Queries on session timelines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import strip
from tokenloom.operators import replay
from tokenloom.plans.registry import Registry
from tokenloom.sources.tables import table

_all = Registry()
query, QUERIES, SQL = _all.query, _all.queries, _all.sql
#: Kinds by their letters.
KINDS = {"user": "User", "assistant": "Assistant", "toolcall": "ToolCall", "toolresult": "ToolResult", "toolerror": "ToolError", "system": "System"}


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """replay_event with clean sessions and kinds; `seq` is the order of arrival."""
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return table(spark, folder, "replay_event").select(
        "source", F.lower(strip(F.col("session"))).alias("session"), F.col("event_id").alias("seq"), "ts_ms", names[F.regexp_replace(F.lower("kind"), "[^a-z]", "")].alias("kind"), "title", "detail", "call_id", "dedup_key")


def once(spark: SparkSession, folder: str) -> DataFrame:
    return replay.once(rows(spark, folder))


_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items())
_ROWS = rf"""r as (select source, lower(regexp_replace(session, '^[\s\p{{Z}}\p{{Cf}}\x00-\x20]+|[\s\p{{Z}}\p{{Cf}}\x00-\x20]+$', '', 'g')) as session, event_id as seq, ts_ms, case regexp_replace(lower(kind), '[^a-z]', '', 'g') {_CASES} end as kind, title, detail, call_id, dedup_key from replay_event),
  o as (select * from r qualify dedup_key is null or row_number() over (partition by source, session, dedup_key order by seq) = 1),
  f as (select *, case when ts_ms > 0 then ts_ms - min(case when ts_ms > 0 then ts_ms end) over s else coalesce(max(case when ts_ms > 0 then ts_ms end) over s - min(case when ts_ms > 0 then ts_ms end) over s, 0)
      + 1000 * row_number() over (partition by source, session, ts_ms > 0 order by seq) end as offset_ms from o window s as (partition by source, session))"""


@query("replay_dedup", f"with {_ROWS} select source, session, seq from o")
def replay_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder).select("source", "session", "seq")


@query("replay_order", f"with {_ROWS} select source, session, seq, row_number() over (partition by source, session order by ts_ms <= 0, case when ts_ms > 0 then ts_ms end, seq) as place from o")
def replay_order(spark: SparkSession, folder: str) -> DataFrame:
    return replay.ordered(once(spark, folder)).select("source", "session", "seq", "place")


@query("replay_offsets", f"with {_ROWS} select source, session, seq, offset_ms from f")
def replay_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return replay.offsets(once(spark, folder)).select("source", "session", "seq", "offset_ms")


@query("replay_call_names", f"with {_ROWS} select source, session, seq, coalesce(case when call_id is not null then last_value(case when kind = 'ToolCall' then title end ignore nulls) over (partition by source, session, call_id order by seq rows between unbounded preceding and 1 preceding) end, 'tool result') as call_name from o qualify kind in ('ToolResult', 'ToolError')")
def replay_call_names(spark: SparkSession, folder: str) -> DataFrame:
    return replay.call_names(once(spark, folder)).where("call_name is not null").select("source", "session", "seq", "call_name")


@query("replay_summary", f"with {_ROWS} select source, session, coalesce(min(case when ts_ms > 0 then ts_ms end), 0) as first_ms, coalesce(max(case when ts_ms > 0 then ts_ms end), 0) as last_ms, max(offset_ms) as duration_ms, count(*) as events from f group by source, session")
def replay_summary(spark: SparkSession, folder: str) -> DataFrame:
    return replay.summary(replay.offsets(once(spark, folder)))


@query("replay_seek", f"with {_ROWS} select source, session, arg_max(seq, (offset_ms, seq)) as seq from f where offset_ms <= 60000 group by source, session")
def replay_seek(spark: SparkSession, folder: str) -> DataFrame:
    return replay.seek(replay.offsets(once(spark, folder)), F.lit(60_000))


@query("replay_timeline", f"with {_ROWS}, d as (select *, max(offset_ms) over (partition by source, session) as d from f), c as (select *, case when d > 0 then least((offset_ms * 80 + d // 2) // d, 80) else 0 end as cell from d) select source, session, cell, arg_max(seq, (offset_ms, seq)) as seq, count(*) as events from c group by source, session, cell")
def replay_timeline(spark: SparkSession, folder: str) -> DataFrame:
    placed = replay.offsets(once(spark, folder))
    return replay.timeline(placed, replay.summary(placed), 80)


@query("replay_truncate", f"""with {_ROWS}, n as (select *, row_number() over (partition by source, session order by seq) as n from o) select source, session, seq, coalesce(detail, '') as detail from n where n <= {replay.MOST_EVENTS}""")
def replay_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """At the usual limits of events and bytes."""
    return replay.truncated(once(spark, folder)).select("source", "session", "seq", "detail")


# Transcript records


def _as_b(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the second source as its records: messages, calls, outputs."""
    r = rows(spark, folder).where("source = 'codex'")
    text = F.array(F.struct(F.lit("input_text").alias("type"), F.coalesce("detail", F.lit("")).alias("text")))
    message = F.to_json(F.struct(F.lit("message").alias("type"), F.lower("kind").alias("role"), text.alias("content"), F.col("dedup_key").alias("id")))
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.coalesce("title", F.lit("tool")).alias("name"), F.coalesce("detail", F.lit("")).alias("arguments"), "call_id"))
    output = F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.coalesce("detail", F.lit("")).alias("output"), F.when(F.col("kind") == "ToolError", "failed").alias("status"), "call_id"))
    payload = F.when(F.col("kind") == "ToolCall", call).when(F.col("kind").isin("ToolResult", "ToolError"), output).otherwise(message)
    return r.select("session", "seq", F.parse_json(F.concat(F.lit('{"type":"response_item","payload":'), payload, F.lit("}"))).alias("record"))


def _flat(c: str) -> str:
    f = rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"
    return f"case when length({f}) <= 4096 then {f} else left({f}, case when substring({f}, 4097, 1) = ' ' then 4097 else 4096 end) || '…' end"


@query("replay_messages", f"with {_ROWS} select * from (select session, seq, kind, {_flat('detail')} as detail, 'codex:message:' || left(dedup_key, 512) as key from r where source = 'codex' and kind in ('User', 'Assistant', 'System')) where detail <> ''")
def replay_messages(spark: SparkSession, folder: str) -> DataFrame:
    out = replay.items(_as_b(spark, folder)).where("kind in ('User', 'Assistant', 'System')")
    return out.select("session", "seq", "kind", "detail", F.col("dedup_key").alias("key"))


@query("replay_tools", f"""with {_ROWS}, b as (select session, seq, kind, call_id, case when kind = 'ToolCall' then {_flat("coalesce(title, 'tool')")} end as called, {_flat('detail')} as detail from r where source = 'codex' and kind in ('ToolCall', 'ToolResult', 'ToolError'))
  select session, seq, kind, coalesce(called, case when coalesce(call_id, '') <> '' then last_value(called ignore nulls) over (partition by session, call_id order by seq rows between unbounded preceding and 1 preceding) end, 'tool result') as title, detail,
  case when kind = 'ToolCall' then 'codex:call:' else 'codex:result:' end || nullif(left(call_id, 512), '') as key from b""")
def replay_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, and results titled by their calls."""
    out = replay.items(_as_b(spark, folder)).where("kind in ('ToolCall', 'ToolResult', 'ToolError')")
    return replay.titled(out.withColumn("source", F.lit("codex"))).select("session", "seq", "kind", "title", "detail", F.col("dedup_key").alias("key"))


def _as_a(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the first source as its records. By seq % 7 a message's content is text (0), an object
    (1), missing (2), null (3), or an array of blocks; where it is 4 there is no message, and the text is the record's."""
    r = rows(spark, folder).where("source = 'claude'")
    text = F.coalesce("detail", F.lit(""))
    said = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("call_id").alias("id"), F.col("title").alias("name"), F.struct(text.alias("text")).alias("input")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_use_id"), (F.col("kind") == "ToolError").alias("is_error"), text.alias("content")))
    kind = F.col("kind")
    block = F.when(kind == "ToolCall", use).when(kind.isin("ToolResult", "ToolError"), result).otherwise(said)
    talk, form = kind.isin("User", "Assistant", "System"), F.col("seq") % 7
    quoted = F.substring(F.to_json(F.struct(text.alias("t"))), 6, 2_000_000_000)  # "..."}
    content = F.when(talk & (form == 0), F.concat(F.lit(',"content":'), quoted)).when(talk & (form == 1), ',"content":{"text":"x"}}').when(talk & (form == 2), "}").when(talk & (form == 3), ',"content":null}')
    content = content.otherwise(F.concat(F.lit(',"content":['), block, F.lit("]}")))
    role = F.when(kind.isin("Assistant", "ToolCall"), "assistant").when(kind == "System", "system").otherwise("user")
    message = F.when(talk & (form == 4), F.concat(F.lit('"content":'), quoted)).otherwise(F.concat(F.lit('"message":{"role":"'), role, F.lit('"'), content, F.lit("}")))
    json = F.concat(F.lit('{"type":"'), role, F.lit('","uuid":"u'), F.col("seq").cast("string"), F.lit('",'), message)
    return r.select("source", "session", "seq", F.parse_json(json).alias("record"))


@query("replay_blocks", f"""with {_ROWS}, b as (select *, kind in ('User', 'Assistant', 'System') as talk, seq % 7 as form, {_flat('detail')} as shown, case when kind = 'ToolCall' then case when title is null then 'tool' else {_flat('title')} end end as called from r where source = 'claude')
  select session, seq, case when talk and form = 4 then 'System' when kind = 'System' then 'Assistant' else kind end as kind,
    case when talk then case kind when 'Assistant' then 'assistant' when 'System' then 'system' else 'user' end
      else coalesce(called, last_value(called ignore nulls) over (partition by session, nullif(call_id, '') order by seq rows between unbounded preceding and 1 preceding), 'tool result') end as title,
    case when kind = 'ToolCall' and shown = '' then '{{"text":""}}' when kind = 'ToolCall' and detail is null then '{{}}' else shown end as detail, case when talk and form in (0, 4) then 'u' || seq else 'claude:u' || seq || ':0' end as key, case when not talk then nullif(call_id, '') end as call_id
  from b where kind is not null and (not talk or form = 0 or form > 3 and shown <> '')""")
def replay_blocks(spark: SparkSession, folder: str) -> DataFrame:
    out = replay.titled(replay.blocks(_as_a(spark, folder)), "seq", "position")
    return out.select("session", "seq", "kind", "title", "detail", F.col("dedup_key").alias("key"), "call_id")


@query("replay_value_preview", f"with {_ROWS} select seq, {_flat('detail')} as shown, kind = 'ToolError' as failed from r where kind in ('ToolResult', 'ToolError')")
def replay_value_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The text of nested JSON values, and whether they report a failure."""
    r = rows(spark, folder).where("kind in ('ToolResult', 'ToolError')")
    text = F.coalesce("detail", F.lit(""))
    inner = F.struct(F.when(F.col("kind") == "ToolError", "error").otherwise("done").alias("status"), text.alias("text"))
    nested = F.to_json(F.struct(F.array(F.lit(None).cast("string")).alias("data"), F.array(inner).alias("content")))
    return r.select("seq", replay.value_preview(nested).alias("shown"), replay.reports_failure(nested).alias("failed"))


