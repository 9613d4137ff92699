"""Events of several devices: export, validation, and the merge that counts each event once."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.display import terminal_text
from tokenloom.functions.models import event_id, keyed_id
from tokenloom.sources.tables import TOKENS

LONGEST_TEXT = 4096
# Events and bytes of text that one bundle may have.
MOST_EVENTS, MOST_BYTES = 1_000_000, 128 * 1024 * 1024


def with_canonical_id(events: DataFrame) -> DataFrame:
    """`events` with `id`: shared by all devices for keyed events; for others the content's hash
    and the number of its occurrence on the device, so that equal requests stay apart."""
    content = event_id(F.lit("fallback"), *(F.col(c) for c in ("source", "ts", "model", "session", "project", *TOKENS)))
    keyless = events.where("dedup_key is null").withColumn("__content", content)
    nth = F.row_number().over(Window.partitionBy("device_id", "__content").orderBy("seq")) - 1
    numbered = keyless.withColumn("id", F.concat("__content", F.lit(":"), nth.cast("string"))).drop("__content")
    return events.where("dedup_key is not null").withColumn("id", keyed_id(F.col("source"), F.col("dedup_key"))).unionByName(numbered)


def merged(events: DataFrame) -> DataFrame:
    """One row an id, that of the highest rank, then most output, then first seen, with
    `observed_on`, the sorted devices that hold it. One shuffle; copies meet as partial winners."""
    rest = [c for c in events.columns if c not in ("id", "device_id")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("dedup_rank"), F.col("output_tokens"), -F.col("seq")))
    return events.groupBy("id").agg(best.alias("x"), F.array_sort(F.collect_set("device_id")).alias("observed_on")).select("id", "x.*", "observed_on")


def observed_locally(events: DataFrame, device: str) -> DataFrame:
    """With one device there is nothing to merge."""
    return events.withColumn("observed_on", F.array(F.lit(device)))


def aliased(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """`project` replaced by its alias (path, name) where there is one. The planner broadcasts
    the aliases while they are small; with several for a path the smallest name counts."""
    one = aliases.groupBy("path").agg(F.min("name").alias("__name")).withColumnRenamed("path", "__path")
    return events.join(one, F.col("project") == F.col("__path"), "left").withColumn("project", F.coalesce("__name", "project")).drop("__path", "__name")


def safe_text(c: Column, most: int = LONGEST_TEXT) -> Column:
    return c.isNotNull() & (c != "") & (F.octet_length(c) <= most) & (terminal_text(c) == c)


def bundle_problems(bundles: DataFrame, events: DataFrame, devices: DataFrame | None = None, local: str | None = None, version: int = 1, most_events: int = MOST_EVENTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """bundle_id, problem of each bundle that is refused as a whole, the first that applies: another version, a
    device id that isn't 1 to 96 letters, digits and dashes or is that of this machine (`local`), an exporter
    version or device name that is missing, too long or unsafe to show, an event whose id, model, session or project
    is, more events or text than is taken. devices: device_id, name; without it names aren't looked at."""
    texts = [F.col(c) for c in ("id", "model", "session", "project")]
    bad = ~reduce(and_, map(safe_text, texts))
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    sums = events.groupBy("bundle_id").agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    joined = bundles.join(sums, "bundle_id", "left")
    named = F.lit(True)
    if devices is not None:
        joined = joined.join(devices.groupBy("device_id").agg(F.min("name").alias("__name")), "device_id", "left")
        named = safe_text(F.col("__name"), 128)
    own = F.coalesce(F.col("device_id") == local, F.lit(False)) if local else F.lit(False)
    problem = (
        F.when(F.coalesce(F.col("bundle_version") != version, F.lit(True)), "version").when(~F.coalesce(F.col("device_id").rlike("^[A-Za-z0-9-]{1,96}$"), F.lit(False)), "device id").when(own, "local device")
        .when(~safe_text(F.col("exporter_version")), "exporter version").when(~named, "device name").when(F.col("bad") > 0, "unsafe text").when(F.col("n") > most_events, "too many events").when(F.col("bytes") > most_bytes, "too much text")
    )
    return joined.select("bundle_id", problem.alias("problem")).where("problem is not null")


def exported(events: DataFrame) -> DataFrame:
    """The rows of a device's export: canonical ids, raw paths, no texts. Written with
    mode overwrite, the commit protocol replaces the former export as a whole."""
    return with_canonical_id(events).select("device_id", "id", "source", "ts", "model", "session", "project", *TOKENS, "dedup_rank")


def status(devices: DataFrame) -> DataFrame:
    """Local devices first, then by name; a device without a usable bundle has a problem."""
    problem = F.coalesce("problem", F.when(~F.col("available"), "unavailable"))
    place = F.row_number().over(Window.orderBy(F.col("is_local").desc(), F.col("name"), F.col("device_id")))
    return devices.select("device_id", "name", "is_local", problem.alias("problem"), place.cast("long").alias("place"))
