"""The queries of the general data-processing problems 4, 5 and 6, and their SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import message_key, project_path
from tokenloom.operators import delivery, drift, rolling
from tokenloom.sources.tables import TOKENS, table


def _usage_rank() -> dict[str, Column | list[Column]]:
    return {"source": F.col("source"), "key": F.col("dedup_key"), "better": [F.col("dedup_rank"), F.col("output_tokens")], "row": F.col("seq")}


def _assistant_rank() -> dict[str, Column | list[Column]]:
    return {"source": F.lit("claude"), "key": F.col("message_id"), "better": [F.col("has_stop_reason").cast("int"), F.col("output_tokens")], "row": F.col("record_no")}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    usage = table(spark, folder, "usage_event").select("source", "dedup_key", "dedup_rank", "output_tokens", "seq")
    spoken = table(spark, folder, "assistant_record").select("message_id", "has_stop_reason", "output_tokens", "record_no")
    a = delivery.surplus(usage, **_usage_rank()).select(F.lit("usage_event").alias("record_table"), F.col("seq").alias("row_id"))
    b = delivery.surplus(spoken, **_assistant_rank()).select(F.lit("assistant_record").alias("record_table"), F.col("record_no").alias("row_id"))
    return a.unionByName(b)


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The messages themselves: usage_event with exactly one row of each."""
    return delivery.kept(table(spark, folder, "usage_event"), **_usage_rank())


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Of each row only its project, day and total go through the deduplication."""
    total = sum((F.coalesce(F.col(t), F.lit(0)).cast("long") for t in TOKENS), F.lit(0).cast("long"))
    day = F.when(F.col("ts") != 0, F.floor(F.col("ts") / 86400)).cast("int")
    return table(spark, folder, "usage_event").select("batch_no", "source", "dedup_key", "dedup_rank", "output_tokens", "seq", project_path(F.col("project")).alias("project"), day.alias("day"), total.alias("total"))


def _daily(rows: DataFrame, times: Column | None = None) -> DataFrame:
    return rolling.daily(rows, F.col("project"), F.col("day"), F.col("total"), times)


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = _amounts(spark, folder).drop("batch_no")
    return rolling.plant(rolling.shards(_daily(delivery.kept(rows, **_usage_rank()))))


def _day_text() -> Column:
    return F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_text")


def p4_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages of every project and day, idle days included."""
    return _rolled(_trees(spark, folder))


def _rolled(trees: DataFrame) -> DataFrame:
    return rolling.trailing(trees).select(F.col("entity").alias("project"), _day_text(), "total_7", "n_7", "avg_7", "total_30", "n_30", "avg_30")


def p4_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of `p4_rolling`, from trees of the earlier half of the batches and the later half as
    corrections: new messages are added, a copy that is beaten by a later one is taken back."""
    rows = _amounts(spark, folder)
    half = rows.agg(F.floor(F.max("batch_no") / 2)).scalar()
    late = F.coalesce(F.col("batch_no") > half, F.lit(False))
    stored = delivery.kept(rows.where(~late).drop("batch_no"), **_usage_rank())
    fresh, better = delivery.accept_batch(stored, rows.where(late).drop("batch_no"), **_usage_rank())
    key = message_key(F.col("dedup_key"))
    beaten = stored.withColumn("key", key).join(better.select("source", key.alias("key")), ["source", "key"], "left_semi").drop("key")
    parts = [r.select("project", "day", "total", F.lit(times).alias("times")) for r, times in ((fresh, 1), (better, 1), (beaten, -1))]
    changes = _daily(parts[0].unionByName(parts[1]).unionByName(parts[2]), F.col("times"))
    trees = rolling.correct(rolling.plant(rolling.shards(_daily(stored))), changes)
    return _rolled(trees)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.trailing(_trees(spark, folder)).where("total_7 = 0 and total_30 <> 0").select(F.col("entity").alias("project"), _day_text())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.file_changes(table(spark, folder, "raw_record"))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable record under one schema."""
    lines = table(spark, folder, "raw_record")
    return drift.consistent(lines, drift.union_schema(lines))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Of the consistent table: records of each file and the sum of a field that has changed its name."""
    return p5_table(spark, folder).groupBy("file_no").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("tokens_input").cast("double")), F.lit(0.0)).cast("long").alias("input"))


_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}\p{{Cf}}\x00-\x20]+|[\s\p{{Z}}\p{{Cf}}\x00-\x20]+$', '', 'g')"
_KEY = r"nullif(regexp_replace(lower(" + _STRIP + r"), '^(?:claude|codex):(?:v\d+:)?', ''), '')"
_KEPT = f"""(select * from (select *, {_KEY.format(c='dedup_key')} as k from usage_event)
  qualify k is null or row_number() over (partition by source, k order by dedup_rank desc nulls last, output_tokens desc nulls last, seq) = 1)"""
_ROLLING = rf"""
with days as (
  select regexp_replace({_STRIP.format(c='project')}, '[\s/\\]+$', '') as project, cast(floor(ts / 86400) as bigint) as day,
    sum(input_tokens + output_tokens + cache_read + coalesce(cache_write_5m, 0) + coalesce(cache_write_1h, 0)) as total, count(*) as n
  from {_KEPT} where ts <> 0 and project is not null group by 1, 2),
spans as (select project, min(day) as a, max(day) as b from days where project <> '' group by 1),
dense as (select s.project, d.day, coalesce(x.total, 0) as total, coalesce(x.n, 0) as n
  from spans s, lateral (select unnest(range(s.a, s.b + 1)) as day) d left join days x on x.project = s.project and x.day = d.day),
rolled as (select project, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as day_text,
  cast(sum(total) over w7 as bigint) as total_7, cast(sum(n) over w7 as bigint) as n_7, cast(sum(total) over w7 as bigint) / 7.0::double as avg_7,
  cast(sum(total) over w30 as bigint) as total_30, cast(sum(n) over w30 as bigint) as n_30, cast(sum(total) over w30 as bigint) / 30.0::double as avg_30
  from dense window w7 as (partition by project order by day rows 6 preceding), w30 as (partition by project order by day rows 29 preceding))
"""

QUERIES = {"p4_found": p4_found, "p4_rolling": p4_rolling, "p4_corrected": p4_corrected, "p5_found": p5_found, "p5_table": p5_table, "p5_records": p5_records, "p6_found": p6_found, "p6_kept": p6_kept}

SQL = {
    "p4_found": _ROLLING + "select project, day_text from rolled where total_7 = 0 and total_30 <> 0",
    "p4_rolling": _ROLLING + "select * from rolled",
    "p4_corrected": _ROLLING + "select * from rolled",
    "p5_records": """select file_no, count(*) as records, cast(coalesce(sum(cast(coalesce(nullif(raw_line ->> '$.tokens.input', ''), nullif(raw_line ->> '$.tokens.inputTokens', ''), nullif(raw_line ->> '$.tokens.input_tokens', '')) as double)), 0) as bigint) as input
  from raw_record where json_valid(raw_line) and json_type(case when json_valid(raw_line) then raw_line end) = 'OBJECT' group by file_no""",
    "p6_found": f"""
select 'usage_event' as record_table, seq as row_id from (
  select seq, row_number() over (partition by source, k order by dedup_rank desc nulls last, output_tokens desc nulls last, seq) as place
  from (select *, {_KEY.format(c='dedup_key')} as k from usage_event) where k is not null) where place > 1
union all
select 'assistant_record', record_no from (
  select record_no, row_number() over (partition by k order by has_stop_reason desc nulls last, output_tokens desc nulls last, record_no) as place
  from (select *, {_KEY.format(c='message_id')} as k from assistant_record) where k is not null) where place > 1
""",
    "p6_kept": f"select * exclude (k) from {_KEPT}",
}
