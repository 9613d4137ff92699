"""The summary report: every roll-up of one set of priced events, as one JSON document or as text.

Events are priced and carry `observed_on`. Buckets are computed in one pass over the events; a
document's lists are as long as there are models, projects, devices and days, whatever the number of events.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import display
from tokenloom.operators import pricing, rollups
from tokenloom.operators.filters import SHARED
from tokenloom.sources.tables import TOKENS

MEASURES = [*TOKENS, "total", "cost_usd", "cost_coverage", "requests", "sessions", "last_ts"]
#: Of the text report: how many models and projects it lists, and how wide their names may be.
MOST_MODELS, MOST_PROJECTS, WIDE_MODEL, WIDE_PROJECT = 12, 10, 48, 32


def buckets(events: DataFrame) -> DataFrame:
    """section (total, source, model, project, device, day, hour), label and the measures of each
    bucket. A missing model or project is `unknown`."""
    dims = {"source": F.col("source"), "model": F.coalesce("model", F.lit("unknown")), "project": F.coalesce("project", F.lit("unknown")), "device": rollups.device_bucket(), "day": rollups.day().cast("string"), "hour": F.format_string("%02d", rollups.hour())}
    rows = events.withColumns({f"d_{k}": F.when(F.col("ts") > 0, c) if k == "hour" else c for k, c in dims.items()})
    columns = [F.col(f"d_{k}") for k in dims]
    grouped = rows.groupingSets([[], *([c] for c in columns)], *columns).agg(F.grouping_id().alias("gid"), *rollups.measures(cost=True))
    whole = (1 << len(columns)) - 1
    section = F.when(F.col("gid") == whole, "total")
    for i, k in enumerate(dims):
        section = section.when(F.col("gid") == whole - (1 << (len(columns) - 1 - i)), k)
    out = grouped.select(section.alias("section"), F.coalesce(*columns).alias("label"), *TOKENS, "total", pricing.dollars(F.col("cost")).alias("cost_usd"), pricing.coverage(F.col("priced_tokens"), F.col("unpriced_tokens")).alias("cost_coverage"), "requests", "sessions", "last_ts")
    return out.where("section = 'total' or label is not null")


def _bucket(extra: dict[str, Column]) -> Column:
    tokens = F.struct(*(F.col(t).alias(t) for t in (*TOKENS, "total")))
    return F.struct("label", tokens.alias("tokens"), *(m for m in MEASURES if m not in (*TOKENS, "total")), *(c.alias(k) for k, c in extra.items()))


def json_document(found: DataFrame, devices: DataFrame, unpriced: DataFrame, scan: DataFrame, today: str, now: int, window_days: int | None = None) -> DataFrame:
    """json: the whole report from `buckets`. Lists are ordered by tokens, days and hours by time; every hour
    is there; `today` is null where nothing was used on that day."""
    names = devices.select(F.col("device_id").alias("label"), F.col("name").alias("device"))
    rows = found.join(names, "label", "left").withColumn("device", F.when(F.col("label") == SHARED, "Shared").otherwise(F.coalesce("device", "label")))
    hours = found.sparkSession.range(24).select(F.lit("hour").alias("section"), F.format_string("%02d", "id").alias("label"))
    rows = rows.join(hours, ["section", "label"], "full").fillna(0, [m for m in MEASURES if m != "cost_coverage"]).fillna(1.0, ["cost_coverage"])
    by_tokens = F.struct((-F.col("total")).alias("a"), F.col("label").alias("b"))

    def listed(section: str, order: Column, extra: dict[str, Column]) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct(order.alias("o"), _bucket(extra).alias("x")))))
        return F.transform(ordered, lambda e: e["x"])

    label = F.col("label")
    one = lambda where: F.first(F.when(where, _bucket({})), ignorenulls=True)
    lists = rows.agg(
        one(F.col("section") == "total").alias("total"), one((F.col("section") == "day") & (label == today)).alias("today"), listed("source", label, {"source": label}).alias("by_source"),
        listed("model", by_tokens, {}).alias("by_model"), listed("project", by_tokens, {}).alias("by_project"), listed("device", by_tokens, {"device": F.col("device")}).alias("by_device"),
        listed("day", label, {"date": label}).alias("daily"), listed("hour", label, {"hour": label.cast("int")}).alias("by_hour"))
    device = F.struct(F.col("device_id").alias("id"), "name", F.col("host").alias("ssh_host"), F.col("is_local").alias("local"), "available", "exporter_version", F.when(F.col("generated_at") > 0, F.col("generated_at")).alias("synced_ts"), "problem")
    known = devices.agg(F.array_sort(F.collect_list(device)).alias("devices"))
    missing = unpriced.agg(F.array_sort(F.collect_list("model")).alias("unpriced_models"))
    parts = lists.crossJoin(known).crossJoin(missing).crossJoin(scan.select(F.struct("*").alias("scan")))  # one row each
    head = [F.lit(window_days).cast("int").alias("window_days"), F.lit(now).alias("generated_ts")]
    return parts.select(F.to_json(F.struct(*head, *parts.columns), {"ignoreNullFields": "false"}).alias("json"))


def text_lines(found: DataFrame, unpriced: DataFrame, scan: DataFrame, today: str, now: int, window_days: int | None = None) -> DataFrame:
    """n, line: the report as text. scan: one row of events, duplicates, synthetic."""
    cost = display.money_partial(F.col("cost_usd"), F.col("cost_coverage"))
    right = lambda c, n: F.lpad(c, F.greatest(F.length(c), F.lit(n)), F.lit(" "))
    sums = F.concat(F.lit("  "), right(display.count(F.col("total")), 15), F.lit("  "), right(cost, 10), F.lit("  "), right(display.count(F.col("requests")), 9), F.lit("  "), right(display.count(F.col("sessions")), 8))
    lit = lambda n, text: found.sparkSession.range(1).select(F.lit(n).alias("n"), F.lit("").alias("k"), F.lit(text).alias("line"))
    rows = lambda n, df, line, k=F.lit(""): df.select(F.lit(n).alias("n"), k.cast("string").alias("k"), line.alias("line"))
    total = found.where("section = 'total'")
    out = [lit(0, f"summary — {'all time' if window_days is None else f'last {window_days} days'}"), lit(1, ""), lit(2, f"  {'tokens':>15}  {'cost':>10}  {'requests':>9}  {'sessions':>8}")]
    out += [rows(3, total, F.concat(sums, F.lit("   TOTAL"))), rows(4, found.where("section = 'source'"), F.concat(sums, F.lit("   "), F.initcap("label")), F.col("label"))]
    if window_days != 1:
        day = found.where((F.col("section") == "day") & (F.col("label") == today))
        idle = found.sparkSession.range(1).select(F.lit(today).alias("label")).join(day, "label", "left").fillna(0, [m for m in MEASURES if m != "cost_coverage"]).fillna(1.0, ["cost_coverage"])
        out += [lit(5, ""), rows(6, idle, F.concat(sums, F.lit("   today")))]
    t = lambda c: display.tokens(c)
    out += [lit(7, ""), rows(8, total, F.concat(F.lit("  input "), t(F.col("input_tokens")), F.lit("  ·  output "), t(F.col("output_tokens")), F.lit("  ·  cache read "), t(F.col("cache_read")), F.lit("  ·  cache write "), t(F.col("cache_write_5m") + F.col("cache_write_1h"))))]
    for n, section, title, most, wide in ((9, "model", "By model", MOST_MODELS, WIDE_MODEL), (12, "project", "By project", MOST_PROJECTS, WIDE_PROJECT)):
        first = found.where(F.col("section") == section).orderBy(F.col("total").desc(), "label").limit(most).withColumn("shown", display.ellipsize(display.terminal_text(F.col("label")), wide))
        width = first.agg(F.max(F.length("shown"))).scalar()
        price = F.when(F.col("cost_coverage") >= 0.999, display.money(F.col("cost_usd"))).otherwise("—") if section == "model" else cost
        line = F.concat(F.lit("    "), F.rpad("shown", F.greatest(F.length("shown"), width), F.lit(" ")), F.lit("  "), right(display.count(F.col("total")), 15), F.lit("  "), right(price, 10))
        line = line if section == "model" else F.concat(line, F.lit("  "), display.relative(F.col("last_ts"), F.lit(now)))
        heads = first.limit(1).select(F.explode(F.array(F.struct(F.lit(n).alias("n"), F.lit("").alias("line")), F.struct(F.lit(n + 1).alias("n"), F.lit(f"  {title}").alias("line")))).alias("x")).select("x.n", F.lit("").alias("k"), "x.line")
        out += [heads, rows(n + 2, first, line, F.concat(F.lpad((F.lit((1 << 63) - 1) - F.col("total")).cast("string"), 20, "0"), "label"))]
    names = unpriced.agg(F.array_sort(F.collect_list(display.terminal_text(F.col("model")))).alias("names")).where(F.size("names") > 0)
    left = total.crossJoin(names).select(F.concat(F.lit("  "), display.share(1 - F.col("cost_coverage")), F.lit(" of tokens are on "), F.when(F.size("names") == 1, "a model").otherwise("models"), F.lit(" with no price on file: "), F.array_join("names", ", ")).alias("line"))
    out += [rows(15, left, F.lit("")), rows(16, left, F.col("line"))]
    out += [lit(17, ""), rows(18, scan, F.concat(F.lit("  scanned "), display.count(F.col("events")), F.lit(" events · "), display.count(F.col("duplicates")), F.lit(" duplicates · "), display.count(F.col("synthetic")), F.lit(" synthetic")))]
    return reduce(DataFrame.unionByName, out).orderBy("n", "k").select("n", "line")
