"""Queries that run as streams over the tables' files, to the end of what is there."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.graph import scratch
from tokenloom.plans.registry import Registry
from tokenloom.plans.usage import EVENTS, RAW, TOTAL, raw
from tokenloom.sources import files
from tokenloom.sources.tables import TOKENS, table
from tokenloom.sources.tail import Tail
from tokenloom.streaming import usage as streaming

_all = Registry()
query, QUERIES, SQL = _all.query, _all.queries, _all.sql

#: Micro-batches in which a table arrives.
ARRIVALS = 4


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return streaming.read(spark, folder, "usage_event").fillna(0, list(TOKENS)).withColumn("total", F.expr(TOTAL))


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """`stream` as it came: `ARRIVALS` ranges of batch_no, a micro-batch each, the earliest first.
    The source takes files in the order of their times, so the ranges are written one by one."""
    base = scratch(spark)
    rows = table(spark, folder, "usage_event")
    cuts = sorted(set(rows.where("batch_no is not null").approxQuantile("batch_no", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.001)))
    number = sum(((F.coalesce("batch_no", F.lit(-1)) > c).cast("int") for c in cuts), F.lit(0))
    files = max(1, rows.rdd.getNumPartitions())
    for k in range(len(cuts) + 1):
        rows.where(number == k).repartition(files).write.mode("append").parquet(f"{base}/usage_event.parquet")
    return streaming.read(spark, base, "usage_event", files).fillna(0, list(TOKENS)).withColumn("total", F.expr(TOTAL))


_DAILY = f"with {RAW} select strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as date, cast(sum(total) as bigint) as total, count(*) as requests from raw where ts > 0 group by 1"


@query("stream_daily", _DAILY)
def stream_daily(spark: SparkSession, folder: str) -> DataFrame:
    return streaming.finished(streaming.by_day(stream(spark, folder)), "complete")


@query("stream_late_data", _DAILY)
def stream_late_data(spark: SparkSession, folder: str) -> DataFrame:
    """In arrival order rows come days late; none is lost, each lands in its own day."""
    return streaming.finished(streaming.by_day(arriving(spark, folder)), "complete").select("date", "total", "requests")


@query("stream_hourly", f"with {RAW} select cast(hour(make_timestamp(ts * 1000000)) as bigint) as hour, cast(sum(total) as bigint) as total, count(*) as requests from raw where ts > 0 group by 1")
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return streaming.finished(streaming.by_hour(stream(spark, folder)), "complete")


@query("stream_dedup_replace", "with " + EVENTS + " select seq, source, total from ev")
def stream_dedup_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = arriving(spark, folder).select("seq", "source", "dedup_key", "dedup_rank", "output_tokens", "total")
    return streaming.replaced(rows, F.col("dedup_key"), [F.col("dedup_rank"), F.col("output_tokens")], F.col("seq")).select("seq", "source", "total")


@query("stream_equals_batch", f"with {RAW} select count(distinct ts // 86400) as days, 0 as different from raw where ts > 0")
def stream_equals_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which the stream and one pass over all rows disagree."""
    live = stream_daily(spark, folder).withColumnsRenamed({"total": "a", "requests": "n"})
    day = F.to_date(F.timestamp_seconds("ts")).cast("string")
    whole = raw(spark, folder).where("ts > 0").groupBy(day.alias("date")).agg(F.sum("total").alias("b"), F.count("*").alias("m"))
    both = live.join(whole, "date", "full")
    return both.agg(F.count("*").alias("days"), F.count_if(~(F.col("a").eqNullSafe(F.col("b")) & F.col("n").eqNullSafe(F.col("m")))).cast("int").alias("different"))


@query("change_signature", f"with {RAW}, b as (select coalesce(max(batch_no), 0) as m from raw), s as (select count(*) filter (batch_no < m) as e0, coalesce(sum(total) filter (batch_no < m), 0) as t0, count(*) as e1, coalesce(sum(total), 0) as t1 from raw, b) select e1 as events, cast(t1 as bigint) as tokens, e0 <> e1 or t0 <> t1 as changed from s")
def change_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the last batch changed what is shown."""
    rows = raw(spark, folder).select("batch_no", "total")
    by_batch = rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.sum("total").alias("t"))
    last = F.struct("batch_no", "n", "t")
    whole = by_batch.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max(last).alias("last"))
    return whole.select("events", "tokens", F.coalesce((F.col("last.n") != 0) | (F.col("last.t") != 0), F.lit(False)).alias("changed"))


@query("stream_tail", "select count(*) as lines, cast(sum(strlen(raw_line)) as bigint) as bytes from raw_record")
def stream_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of raw_record as growing files, read through the tail source in two runs of one stream: the
    second goes on at the offsets of the first, also where that ended within a line."""
    base = scratch(spark)
    lines = table(spark, folder, "raw_record").select(F.format_string("%d.jsonl", F.pmod("file_no", F.lit(16))).alias("path"), "file_no", "line_no", F.translate("raw_line", "\n", " ").alias("value"))
    place = Window.partitionBy("path")
    lines = lines.withColumns({"line": F.row_number().over(place.orderBy("file_no", "line_no")), "half": F.ceil(F.count("*").over(place) / 2)})
    spark.dataSource.register(Tail)

    def run() -> DataFrame:
        rows = spark.readStream.format("tail").option("path", f"{base}/files").load().select(F.octet_length("value").alias("n"))
        return streaming.finished(rows, "append", base)

    files.write_files(lines.where("line <= half").withColumn("torn", F.col("line") == F.col("half")), f"{base}/files")
    run()
    files.write_files(lines.withColumn("torn", F.lit(False)), f"{base}/files")
    return run().agg(F.count("*").alias("lines"), F.sum("n").cast("long").alias("bytes"))
