"""Usage events as a stream: roll-ups that are updated, and deduplication that replaces.

Late rows always land in their own day, so no watermark drops them by default; with one, state
stays bounded and rows later than it are left out, which the caller asks for by name.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tokenloom.operators import delivery
from tokenloom.operators.graph import scratch


def read(spark: SparkSession, folder: str, name: str, files: int = 50) -> DataFrame:
    """A table of a data folder as a stream of its files, a folder or one file."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def by_day(events: DataFrame, late: str | None = None) -> DataFrame:
    """Tokens and requests by day; with `late` ("7 days") under a watermark."""
    rows = events.where("ts > 0").withColumn("at", F.timestamp_seconds("ts"))
    rows = rows.withWatermark("at", late) if late else rows
    return rows.groupBy(F.window("at", "1 day")).agg(F.sum("total").alias("total"), F.count("*").alias("requests")).select(F.to_date("window.start").cast("string").alias("date"), "total", "requests")


def by_hour(events: DataFrame) -> DataFrame:
    return events.where("ts > 0").groupBy(F.hour(F.timestamp_seconds("ts")).cast("long").alias("hour")).agg(F.sum("total").alias("total"), F.count("*").alias("requests"))


def finished(stream: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """The result after all input that is there now, written batch by batch to the shared folder;
    in mode complete the last batch is the result, in mode append all are. With the folder `base` of an
    earlier run the stream goes on where that ended."""
    spark = stream.sparkSession
    base = base or scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number:010d}")

    _run(stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    names = _folders(spark, f"{base}/out")
    if not names:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*(names[-1:] if mode == "complete" else names))


def _run(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def replaced(stream: DataFrame, key: Column, better: list[Column], row: Column, buckets: int | None = None) -> DataFrame:
    """Exactly one row of each message after all input that is there now, a better copy in a later
    batch taking the place of an earlier one. The store is bucketed by key, in as many buckets as the session has shuffle partitions; a batch reads and writes
    anew only the buckets that its keys fall into: what was kept and not beaten, and the new rows. A batch that is
    done again reads the same versions and writes the same; of a bucket the version before the last is deleted."""
    spark = stream.sparkSession
    base = scratch(spark)
    store, columns = f"{base}/store", stream.columns
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), row.cast("string"))), F.lit(buckets)).cast("int").alias("bucket")

    def versions() -> dict[int, list[str]]:
        """The versions of each bucket, as folders, the last one last."""
        out: dict[int, list[str]] = {}
        for version in _folders(spark, store):
            for folder in _folders(spark, version):
                out.setdefault(int(folder.rpartition("=")[2]), []).append(folder)
        return out

    def merge(batch: DataFrame, number: int) -> None:
        new = f"{store}/{number:010d}"
        there = {k: [v for v in of if v.rsplit("/", 2)[1] < f"{number:010d}"] for k, of in versions().items()}
        hit = [r.bucket for r in batch.select(bucket).distinct().collect()]  # at most so many as there are buckets
        read = [there[k][-1] for k in hit if there.get(k)]
        if read:
            stored = spark.read.parquet(*read).select(columns)
            fresh, won = delivery.accept_batch(stored.where(key.isNotNull()), batch.where(key.isNotNull()), F.lit(""), key, better, row, clean=False)
            beaten = won.select(key.alias("__beaten"))
            rest = stored.join(beaten, key.eqNullSafe(F.col("__beaten")), "left_anti")
            out = rest.unionByName(fresh).unionByName(won).unionByName(batch.where(key.isNull()))
        else:
            out = delivery.kept(batch, F.lit(""), key, better, row, clean=False)
        out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(new)
        for k in hit:
            for old in there.get(k, [])[:-1]:
                _delete(spark, old)

    _run(stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    last = [of[-1] for of in versions().values()]
    return spark.read.parquet(*last).select(columns) if last else spark.createDataFrame([], stream.schema)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def signature(events: DataFrame) -> DataFrame:
    """events, tokens: what a display compares to see whether anything changed."""
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"))
