"""Timelines of sessions: order, offsets, call names, limits and positions.

Rows have source, session, seq (arrival order), ts_ms (0: undated), kind, title, detail,
call_id and dedup_key.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.display import preview

SESSION = ["source", "session"]
#: Fixed value: what stands for a detail that the limit leaves no room for.
OMITTED = "[detail omitted: replay text limit reached]"
MOST_BYTES = 16 * 1024 * 1024
MOST_EVENTS = 20_000
#: Characters of an identifier that count, and levels of a JSON value that are shown.
MOST_ID, MOST_DEPTH = 512, 128


def once(rows: DataFrame) -> DataFrame:
    """The first delivery of each key; rows without a key all stay."""
    rest = [c for c in rows.columns if c not in (*SESSION, "dedup_key", "seq")]
    first = rows.where("dedup_key is not null").groupBy(*SESSION, "dedup_key").agg(F.min(F.struct("seq", *rest)).alias("x")).select(*SESSION, "dedup_key", "x.*")
    return first.unionByName(rows.where("dedup_key is null"))


def by_time() -> list[Column]:
    """Dated rows by time, then arrival; undated ones last, by arrival."""
    return [F.col("ts_ms") <= 0, F.when(F.col("ts_ms") > 0, F.col("ts_ms")), F.col("seq")]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*SESSION).orderBy(*by_time())).cast("long"))


def offsets(rows: DataFrame) -> DataFrame:
    """`rows` with offset_ms: of dated rows since the first, of undated ones a second each behind the last."""
    whole = Window.partitionBy(*SESSION)
    dated = F.col("ts_ms") > 0
    first, last = F.min(F.when(dated, F.col("ts_ms"))).over(whole), F.max(F.when(dated, F.col("ts_ms"))).over(whole)
    nth = F.row_number().over(Window.partitionBy(*SESSION, ~dated).orderBy("seq"))
    offset = F.when(dated, F.col("ts_ms") - first).otherwise(F.coalesce(last - first, F.lit(0)) + 1000 * nth)
    return rows.withColumn("offset_ms", offset.cast("long"))


def call_names(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with call_name: of a tool's result the title of the last call before it (by `order`,
    else by seq) with its id."""
    calls = F.when(F.col("kind") == "ToolCall", F.col("title"))
    w = Window.partitionBy(*SESSION, "call_id").orderBy(*(order or ("seq",))).rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("call_id").isNotNull(), F.last(calls, ignorenulls=True).over(w))
    result = F.col("kind").isin("ToolResult", "ToolError")
    return rows.withColumn("call_name", F.when(result, F.coalesce(name, F.lit("tool result"))))


def titled(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with the results of tools titled by their calls."""
    named = call_names(rows, *order)
    return named.withColumn("title", F.coalesce("call_name", "title")).drop("call_name")


def summary(with_offsets: DataFrame) -> DataFrame:
    """first_ms, last_ms (0 without dated rows), duration_ms and events of each session."""
    dated = F.when(F.col("ts_ms") > 0, F.col("ts_ms"))
    return with_offsets.groupBy(*SESSION).agg(
        F.coalesce(F.min(dated), F.lit(0)).alias("first_ms"), F.coalesce(F.max(dated), F.lit(0)).alias("last_ms"), F.max("offset_ms").alias("duration_ms"), F.count("*").alias("events"))


def seek(with_offsets: DataFrame, position: Column) -> DataFrame:
    """The last event of each session at or before a position."""
    return with_offsets.where(F.col("offset_ms") <= position).groupBy(*SESSION).agg(F.max_by("seq", F.struct("offset_ms", "seq")).alias("seq"))


def timeline(with_offsets: DataFrame, durations: DataFrame, track: int) -> DataFrame:
    """For each column of a track of so many cells the last event that falls on it."""
    rows = with_offsets.join(durations.select(*SESSION, "duration_ms"), SESSION)
    d = F.col("duration_ms")
    cell = F.when(d > 0, F.least(F.floor((F.col("offset_ms") * track + F.floor(d / 2)) / d), F.lit(track))).otherwise(0)
    return rows.groupBy(*SESSION, cell.cast("long").alias("cell")).agg(F.max_by("seq", F.struct("offset_ms", "seq")).alias("seq"), F.count("*").alias("events"))


def truncated(rows: DataFrame, most_bytes: int = MOST_BYTES, most_events: int = MOST_EVENTS) -> DataFrame:
    """The rows of each session, in arrival order, that fit the limits. A detail that doesn't fit
    is replaced by a note, or by nothing, and reading goes on; a title that doesn't ends it. Sizes
    depend on what was replaced before, so the rows of a session that the first limit admits
    are read in one go."""
    def cut(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        used, details = 0, []
        for title, detail in zip(frame["title"], frame["detail"]):
            room = most_bytes - used - len((title or "").encode())
            if room < 0:
                break
            text = detail or ""
            if len(text.encode()) > room:
                text = OMITTED if len(OMITTED) <= room else ""
            used = most_bytes - room + len(text.encode())
            details.append(text)
        kept = frame.iloc[: len(details)].copy()
        kept["detail"] = details
        return kept

    # At most so many rows of a session get there, whatever its length.
    nth = F.row_number().over(Window.partitionBy(*SESSION).orderBy("seq"))
    first = rows.withColumn("__n", nth).where(F.col("__n") <= most_events).drop("__n")
    return first.groupBy(*SESSION).applyInPandas(cut, rows.schema)


@F.pandas_udf(T.StringType())
def value_preview(values: pd.Series) -> pd.Series:
    """The text that a JSON value shows. What is nested deeper than `MOST_DEPTH` shows nothing; text that is
    no JSON shows itself."""
    import json

    def flat(text: str) -> str:
        short = " ".join(text.split())
        return short if len(short) <= 4096 else short[: 4097 if short[4096] == " " else 4096] + "…"

    def show(v: object, depth: int = 0) -> str:
        if v is None or depth > MOST_DEPTH:
            return ""
        if isinstance(v, str):
            return flat(v)
        if isinstance(v, list):
            return flat(" ".join(s for s in (show(x, depth + 1) for x in v[:64]) if s))
        if isinstance(v, dict):
            if "image_url" in v:
                return "[image]"
            texts = (show(v[k], depth + 1) for k in ("text", "content", "message", "output", "stdout", "stderr") if k in v)
            return next((t for t in texts if t), "") or flat(json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
        return flat(json.dumps(v))

    def parse(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return show(json.loads(text))
        except (ValueError, RecursionError):
            return flat(text)

    return values.map(parse)


@F.pandas_udf(T.BooleanType())
def reports_failure(values: pd.Series) -> pd.Series:
    """Whether a JSON value says, at any depth, that something failed."""
    import json

    def failed(whole: object) -> bool:
        waiting = [whole]
        while waiting:
            v = waiting.pop()
            if isinstance(v, list):
                waiting += v
            elif isinstance(v, dict):
                if v.get("success") is False or v.get("status") in ("failed", "error", "cancelled"):
                    return True
                waiting += v.values()
        return False

    def parse(text: str | None) -> bool:
        try:
            return failed(json.loads(text or "null"))
        except (ValueError, RecursionError):
            return False

    return values.map(parse)


def _text(record: Column | str, path: str) -> Column:
    """A string at a path; null where there is none or anything else."""
    value = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(record, path, "string"))


def blocks(records: DataFrame) -> DataFrame:
    """The events of transcript records with content blocks: `records` (record and other columns) to
    these columns and position, kind, title, detail, call_id and dedup_key.

    A message's content is text, which is one event even if it is empty, or an array, of which each block of text,
    tool use or tool result is one; other content is none. A record without a message is an event
    of the system if its own content shows anything. Whoever isn't the user speaks as Assistant."""
    rest = [F.col(c) for c in records.columns if c != "record"]
    g = lambda path: F.try_variant_get("record", path, "variant")
    kind = _text("record", "$.type")
    rows = records.where(kind.isin("user", "assistant", "system")).select(
        *rest, kind.alias("type"), F.coalesce(_text("record", "$.message.role"), kind).alias("role"), F.left(_text("record", "$.uuid"), F.lit(MOST_ID)).alias("uuid"),
        g("$.message").isNotNull().alias("has_message"), g("$.message.content").alias("content"), g("$.content").alias("own"))
    of = F.schema_of_variant("content")
    speaker = lambda: F.when(F.col("role") == "user", "User").otherwise("Assistant")
    none = F.lit(None).cast("string")
    told = rows.where(~F.col("has_message") & F.col("own").isNotNull()).select(
        *rest, F.lit(0).alias("position"), F.lit("System").alias("kind"), F.col("type").alias("title"), value_preview(F.to_json("own")).alias("detail"), none.alias("call_id"), F.col("uuid").alias("dedup_key")).where("detail <> ''")
    whole = rows.where(F.col("has_message") & (of == "STRING")).select(
        *rest, F.lit(0).alias("position"), speaker().alias("kind"), F.col("role").alias("title"), preview(F.try_variant_get("content", "$", "string")).alias("detail"), none.alias("call_id"), F.col("uuid").alias("dedup_key"))
    items = F.try_variant_get("content", "$", "array<variant>")
    each = rows.where(F.col("has_message") & of.startswith("ARRAY")).select(*rest, "role", "uuid", F.posexplode(items).alias("position", "block"))
    b = lambda path: _text("block", path)
    use, result = b("$.type").isin("tool_use", "server_tool_use"), b("$.type").isin("tool_result", "advisor_tool_result")
    said = (b("$.type") == "text") & (preview(F.coalesce(b("$.text"), F.lit(""))) != "")
    failed = F.try_variant_get("block", "$.is_error", "variant")
    failed = (F.schema_of_variant(failed) == "BOOLEAN") & F.try_variant_get("block", "$.is_error", "boolean")
    sort = F.when(use, "ToolCall").when(result & F.coalesce(failed, F.lit(False)), "ToolError").when(result, "ToolResult").when(said, speaker())
    value = F.when(use, F.to_json(F.try_variant_get("block", "$.input", "variant"))).when(result, F.to_json(F.try_variant_get("block", "$.content", "variant")))
    own_id = F.left(F.when(use, b("$.id")).when(result, b("$.tool_use_id")), F.lit(MOST_ID))
    parts = each.select(
        *rest, "position", sort.alias("kind"), F.when(use, preview(F.coalesce(b("$.name"), F.lit("tool")))).when(result, "tool result").otherwise(F.col("role")).alias("title"),
        F.when(use | result, F.coalesce(value_preview(value), F.lit(""))).otherwise(preview(F.coalesce(b("$.text"), F.lit("")))).alias("detail"),
        F.when(own_id != "", own_id).alias("call_id"), F.concat(F.lit("claude:"), "uuid", F.lit(":"), F.col("position").cast("string")).alias("dedup_key"))
    return told.unionByName(whole).unionByName(parts.where("kind is not null"))


def items(records: DataFrame) -> DataFrame:
    """The events of the second source's response items: `records` (session, seq, record) to
    session, seq, kind, title, detail, call_id and dedup_key. Messages without text are left out."""
    t = lambda path: _text("record", path)
    g = lambda path: F.try_variant_get("record", path, "variant")
    rows = records.where(t("$.type") == "response_item").withColumns({"type": t("$.payload.type"), "role": F.coalesce(t("$.payload.role"), F.lit("system"))})
    parts = F.slice(F.coalesce(F.try_variant_get("record", "$.payload.content", "array<variant>"), F.array().cast("array<variant>")), 1, 64)
    shown = F.filter(parts, lambda v: (_text(v, "$.type") == "input_image") | _text(v, "$.type").isin("input_text", "output_text", "text") & _text(v, "$.text").isNotNull())
    texts = F.transform(shown, lambda v: F.when(_text(v, "$.type") == "input_image", "[image]").otherwise(preview(_text(v, "$.text"))))
    said = preview(F.concat_ws(" ", texts))
    call, output = F.col("type").isin("function_call", "custom_tool_call"), F.col("type").isin("function_call_output", "custom_tool_call_output")
    own = F.left(F.coalesce(F.when(g("$.payload.call_id").isNotNull(), t("$.payload.call_id")).otherwise(F.when(call, t("$.payload.id"))), F.lit("")), F.lit(MOST_ID))
    value = F.to_json(F.when(call, F.coalesce(g("$.payload.arguments"), g("$.payload.input"))).when(output, g("$.payload.output")))
    failed = F.coalesce(t("$.payload.status").isin("failed", "error", "cancelled"), F.lit(False))
    message = F.col("type") == "message"
    key = F.when(message, F.concat(F.lit("codex:message:"), F.left(t("$.payload.id"), F.lit(MOST_ID)))).when(call & (own != ""), F.concat(F.lit("codex:call:"), own)).when(output & (own != ""), F.concat(F.lit("codex:result:"), own))
    # Python sees the values of calls and outputs only.
    tools = rows.where(call | output).select(
        "session", "seq", F.when(call, "ToolCall").when(failed | reports_failure(F.when(output, value)), "ToolError").otherwise("ToolResult").alias("kind"),
        F.when(call, preview(F.coalesce(t("$.payload.name"), F.lit("tool")))).otherwise("tool result").alias("title"),
        F.coalesce(value_preview(value), F.lit("")).alias("detail"), F.when(own != "", own).alias("call_id"), key.alias("dedup_key"))
    speaker = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    messages = rows.where(message).select("session", "seq", speaker.alias("kind"), preview(F.col("role")).alias("title"), said.alias("detail"), F.lit(None).cast("string").alias("call_id"), key.alias("dedup_key")).where("detail <> ''")
    return messages.unionByName(tools)
