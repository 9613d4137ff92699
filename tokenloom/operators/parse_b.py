"""Usage events from transcript lines of the second source."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.json_fields import added, count, first_present, seconds
from tokenloom.functions.models import event_id, normalize_model_b, project_label
from tokenloom.operators.snapshots import deltas
from tokenloom.sources.transcripts import may_bill_b

_CACHED = ("cached_input_tokens", "cache_read_input_tokens")


def usage(lines: DataFrame) -> DataFrame:
    """path, line and the columns of a usage event for each snapshot of `lines` (path, line,
    value) that adds tokens. Model and folder are the last given at or before a line, the thread
    is the first one named; cumulative counters are turned into what each snapshot adds."""
    parsed = lines.where(may_bill_b(F.col("value"))).withColumn("record", F.try_parse_json("value")).where("record is not null")
    g = lambda path, kind="string": F.try_variant_get("record", path, kind)
    kind = g("$.type")
    counted = (kind == "event_msg") & (g("$.payload.type") == "token_count")
    meta, turn = kind == "session_meta", kind == "turn_context"

    def counters(path: str) -> Column:
        at = lambda name: count(F.col("record"), f"{path}.{name}")
        there = F.coalesce(*(g(f"{path}.{n}", "variant") for n in ("input_tokens", *_CACHED, "output_tokens", "total_tokens")))
        cached = F.when(g(f"{path}.{_CACHED[0]}", "variant").isNotNull(), at(_CACHED[0])).otherwise(at(_CACHED[1]))
        return F.when(counted & there.isNotNull(), F.struct(at("input_tokens").alias("input"), cached.alias("cached"), at("output_tokens").alias("output")))

    named = F.when(turn, g("$.payload.model")).when(counted, F.coalesce(first_present(F.col("record"), "$.payload.info.model", "$.payload.info.model_name", "$.payload.model")))
    # Only fields go through the windows, not records; all of them run over one shuffle by path.
    fields = parsed.select(
        F.col("path").alias("file"), "line", counters("$.payload.info.total_token_usage").alias("total"), counters("$.payload.info.last_token_usage").alias("last"),
        F.when(counted & (g("$.payload.rate_limits.limit_id") != ""), g("$.payload.rate_limits.limit_id")).alias("lane"), named.alias("named"),
        F.when(meta, first_present(F.col("record"), "$.payload.session_id", "$.payload.id")).alias("opened"), F.when(turn | meta, g("$.payload.cwd")).alias("given"),
        F.coalesce(meta, F.lit(False)).alias("is_meta"), F.coalesce(counted, F.lit(False)).alias("counts"), seconds(g("$.timestamp")).alias("ts"))
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    rows = fields.withColumns({"model": F.last("named", ignorenulls=True).over(so_far), "thread": F.first("opened", ignorenulls=True).over(so_far), "had_folder": F.first("given", ignorenulls=True).over(before)})
    # The opening record sets the folder only where none is set; each turn sets it anew.
    rows = rows.withColumn("folder", F.last(F.when(~(F.col("is_meta") & F.col("had_folder").isNotNull()), F.col("given")), ignorenulls=True).over(so_far)).where("counts")
    out = deltas(rows.select("file", "line", "lane", "total", "last", "ts", "model", "thread", "folder")).withColumnRenamed("file", "path").where(added(F.col("input"), F.col("cache_read"), F.col("output")) > 0)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    thread = F.coalesce("thread", stem)
    return out.select(
        "path", "line", F.lit("codex").alias("source"), "ts", F.coalesce(F.when(normalize_model_b(F.col("model")) != "", normalize_model_b(F.col("model"))), F.lit("unknown")).alias("model"), thread.alias("session"),
        F.coalesce(project_label(F.col("folder")), F.lit("unknown")).alias("project"), F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), "cache_read",
        F.lit(0).cast("long").alias("cache_write_5m"), F.lit(0).cast("long").alias("cache_write_1h"), event_id(F.lit("codex"), thread, nth, F.col("input"), F.col("cache_read"), F.col("output")).alias("dedup_key"), F.lit(0).cast("tinyint").alias("dedup_rank"),
    )
