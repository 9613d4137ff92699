"""Usage events from transcript lines of the first source."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.json_fields import added, count, first_present, seconds, split_cache_write
from tokenloom.functions.models import normalize_model, project_dir_label, project_label
from tokenloom.sources.tables import TOKENS
from tokenloom.sources.transcripts import may_bill_a


def usage(lines: DataFrame) -> DataFrame:
    """path, line and the columns of a usage event for each billed line of `lines` (path, line,
    value). The working folder is the last one given at or before a line; without any it is the
    folder just below the deepest `projects` in the path. Synthetic models and lines without
    tokens are left out; counts are at most `MOST`. Several deliveries of a message stay, to be settled across files."""
    parsed = lines.where(may_bill_a(F.col("value"))).withColumn("record", F.try_parse_json("value")).where("record is not null")
    g = lambda path, kind="string": F.try_variant_get("record", path, kind)
    marked = F.col("value").contains('"assistant"') & F.col("value").contains('"usage"')
    counts = marked & (g("$.type") == "assistant")
    folder = F.when(~marked | counts, g("$.cwd"))
    n = lambda path: count(F.col("record"), f"$.message.usage.{path}")
    stop = g("$.message.stop_reason", "variant")
    # Only fields go through the window, not records.
    fields = parsed.select(
        "path", "line", F.coalesce(counts, F.lit(False)).alias("counts"), folder.alias("given"), seconds(g("$.timestamp")).alias("ts"), g("$.message.model").alias("model"),
        F.coalesce(first_present(F.col("record"), "$.sessionId", "$.session_id"), F.lit("")).alias("session"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"),
        n("cache_read_input_tokens").alias("cache_read"), n("cache_creation_input_tokens").alias("written"), n("cache_creation.ephemeral_5m_input_tokens").alias("five"), n("cache_creation.ephemeral_1h_input_tokens").alias("hour"),
        F.coalesce(F.schema_of_variant(g("$.message.usage.cache_creation", "variant")).startswith("OBJECT<"), F.lit(False)).alias("split"), g("$.message.id").alias("dedup_key"),
        F.when(stop.isNotNull() & (F.schema_of_variant(stop) != "VOID"), 1).otherwise(0).cast("tinyint").alias("dedup_rank"))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = fields.withColumn("folder", F.last("given", ignorenulls=True).over(so_far)).where("counts")
    from_path = project_dir_label(F.regexp_extract("path", r"^.*/projects/([^/]+)/", 1))
    five, hour = split_cache_write(*(F.col(c) for c in ("written", "five", "hour", "split")))
    rows = rows.withColumns({"cache_write_5m": five.cast("long"), "cache_write_1h": hour.cast("long")})
    out = rows.select(
        "path", "line", F.lit("claude").alias("source"), "ts", normalize_model(F.col("model"), F.lit("claude")).alias("model"), "session",
        F.coalesce(project_label(F.col("folder")), F.when(from_path != "", from_path), F.lit("unknown")).alias("project"), *TOKENS, "dedup_key", "dedup_rank")
    total = added(*(F.col(t) for t in TOKENS))
    return out.where(~F.col("model").startswith("<") & (total > 0) & F.col("dedup_key").isNotNull())
